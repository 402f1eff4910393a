"""Archives to one report for each author and trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import forum
from trialweave.sources import archives


def contextualize(raw: DataFrame) -> DataFrame:
    """Typed raw records to posts and comments in their threads: the joins deal by post, so no bucket is looped over."""
    return forum.contextualized(*archives.posts_and_comments(archives.filtered(raw)))


def curate(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Contextualised records to a row for each trial and author.

    registry: subreddit, alias, nct_id, cutoff (timestamp). The aliases are matched by a broadcast automaton, the only
    thing about trials that workers hold.
    """
    spark = records.sparkSession
    spelled = forum.usable_aliases(registry.withColumn("alias", T.normalize_alias_udf("alias")))
    spelled = spelled.withColumn("alias", T.spaced_numbers(F.col("alias"))).distinct()
    matcher = spark.sparkContext.broadcast(T.Matcher([r[0] for r in spelled.select("alias").distinct().toLocalIterator()]))
    text = F.concat_ws(" ", "title", "initial_post", "report_text")
    rows = records.withColumn("date", V.forum_time(F.col("date_created"))).withColumn("text", text)
    hit = forum.routed(rows, spelled, matcher)
    report = T.report_markdown(*[F.col(c) for c in ("report_type", "subreddit", "date_created", "permalink", "title", "initial_post", "report_text")])
    rows = hit.withColumn("report", report).withColumn("row_id", F.sha2(F.concat_ws(":", "nct_id", "permalink"), 256))
    keep = ["row_id", "nct_id", "author_key", "date_created", "permalink", "subreddit", "report_type", "report", "treatments_mentioned"]
    return forum.by_author(rows.select(*keep), ("nct_id",))
