"""Forum threads and the curation of their records for trials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators.relational import keep_first, maybe_broadcast

SECTION = "## Authored record "  # fixed values: how sections of an author's report are headed and parted
SEPARATOR = "\n\n---\n\n"
AUTHOR_HEADER = "# All records of one pseudonymous author\n\nOnly what is marked as written by the author is theirs; everything else is context."


def author_replies(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """post_id, replies: what a post's author said below it, in order. Authors without a key never match."""
    own = comments.join(posts.select("post_id", "author_key"), ["post_id", "author_key"])
    own = own.where(F.col("body").isNotNull() & ~F.col("body").isin(*T.GONE))
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id", "body")))
    return own.groupBy("post_id").agg(F.transform(ordered, lambda x: x.body).alias("replies"))


def contextualized(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with their authors' replies folded in, and everyone else's comments with the post that they answer.

    posts: post_id, author_key, subreddit, title, selftext, score, timestamp. comments: id, post_id, author_key,
    subreddit, body, score, timestamp. Comments whose post is unknown stay, without title and post.
    """
    rich = posts.join(author_replies(posts, comments), "post_id", "left").withColumn("enriched", T.enriched_text(F.col("selftext"), F.col("replies")))
    none = F.array().cast("array<string>")
    date = V.forum_date_text(F.col("timestamp"))
    submissions = rich.select(
        "subreddit", "title", F.lit("").alias("initial_post"), F.col("enriched").alias("report_text"), F.lit("submission").alias("report_type"),
        "score", date.alias("date_created"), T.submission_permalink(F.col("subreddit"), F.col("post_id"), F.col("title")).alias("permalink"), "author_key",
        F.coalesce("replies", none).alias("author_replies"), F.lit("submissions").alias("content_type"),
    )
    post = rich.select("post_id", F.col("author_key").alias("_op"), "title", "enriched")
    others = comments.join(post, "post_id", "left").where(F.col("author_key").isNull() | F.col("_op").isNull() | (F.col("author_key") != F.col("_op")))
    answers = others.select(
        "subreddit", "title", F.col("enriched").alias("initial_post"), F.col("body").alias("report_text"), F.lit("comment").alias("report_type"),
        "score", date.alias("date_created"), T.comment_permalink(F.col("subreddit"), F.col("post_id"), F.col("id")).alias("permalink"), "author_key",
        none.alias("author_replies"), F.lit("comments").alias("content_type"),
    )
    return submissions.unionByName(answers).withColumn("bucket", T.bucket(F.col("subreddit")))


def registry(trial_aliases: DataFrame, trial_subreddits: DataFrame, trial_dates: DataFrame) -> DataFrame:
    """subreddit, alias, nct_id, cutoff: which alias leads to which trial where, and how late a record may be."""
    return trial_aliases.join(trial_subreddits, "nct_id").join(trial_dates, "nct_id").select("subreddit", "alias", "nct_id", "cutoff").distinct()


def latest_cutoffs(reg: DataFrame, key: str = "subreddit", cutoff: str = "cutoff", name: str = "_latest") -> DataFrame:
    """The latest cut-off of any trial in each subreddit: records after it can matter to none."""
    return reg.groupBy(key).agg(F.max(cutoff).alias(name))


def usable_aliases(aliases: DataFrame, column: str = "alias") -> DataFrame:
    """Aliases long enough to be told from other words; the one short alias that is allowed stays."""
    return aliases.where((F.char_length(column) > 3) | (F.col(column) == T.SHORT_ALIAS))


def mentions(text: Column, matcher) -> Column:
    """Sorted distinct aliases in a normalised text, by a broadcast automaton."""
    @F.pandas_udf(ArrayType(StringType()))
    def find(values: pd.Series) -> pd.Series:
        return values.map(matcher.value.find)

    return find(text)


def alias_matches(records: DataFrame, aliases: DataFrame, text: str, key: str) -> DataFrame:
    """key, alias for every alias that a text contains: the plain plan, which the automaton must equal.

    The aliases are a stated query set, matched against all texts.
    """
    small = maybe_broadcast(aliases.select("alias").distinct())
    hit = F.when(F.col("alias") == T.SHORT_ALIAS, F.col(text).rlike(rf"(?<![\p{{L}}\p{{N}}]){T.SHORT_ALIAS}(?![\p{{L}}\p{{N}}])")).otherwise(F.contains(F.col(text), F.col("alias")))
    return records.select(key, text).join(small, hit).select(key, "alias")


def date_gated(records: DataFrame, cutoffs: DataFrame, date: str, key: str, cutoff: str, inclusive: bool = True) -> DataFrame:
    """Records no later than their key's cut-off (earlier, where not inclusive); dates that cannot be read go."""
    latest = cutoffs.agg(F.max(cutoff)).first()[0]  # a scalar, so that the scan is pruned before the join
    early = records.where(F.col(date).isNotNull())
    if latest is not None:
        early = early.where(F.col(date) <= F.lit(latest))
    joined = early.join(maybe_broadcast(cutoffs.select(key, cutoff)), key)
    return joined.where(F.col(date) <= F.col(cutoff) if inclusive else F.col(date) < F.col(cutoff))


def routed(records: DataFrame, reg: DataFrame, matcher, text: str = "text") -> DataFrame:
    """Records sent to every trial of which they name a treatment in one of its subreddits, in time.

    records: subreddit, date (timestamp), permalink and text. Adds nct_id and treatments_mentioned, the trial's own terms
    among those found. A record stands once for each trial.
    """
    in_time = records.join(maybe_broadcast(latest_cutoffs(reg)), "subreddit").where(F.col("date").isNotNull() & (F.col("date") <= F.col("_latest"))).drop("_latest")
    spelled = in_time.withColumn("_found", mentions(T.normalize_forum_udf(F.col(text)), matcher))
    hit = spelled.where(F.size("_found") > 0).withColumn("alias", F.explode("_found")).join(maybe_broadcast(reg), ["subreddit", "alias"])
    timely = hit.where(F.col("date") <= F.col("cutoff"))
    terms = timely.groupBy("nct_id", "permalink").agg(F.array_sort(F.collect_set("alias")).alias("treatments_mentioned"))
    once = keep_first(timely.drop("alias", "cutoff", "_found"), ["nct_id", "permalink"], [F.col("date")])
    return once.join(terms, ["nct_id", "permalink"])


def by_author(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each author: records in order of time, each under a numbered heading; authors without a key stay apart.

    records: row_id, author_key, date_created, permalink, report, treatments_mentioned and others, of which the first in
    order stays. Of records with one permalink the first stays; blank permalinks are never equal.
    """
    time = V.forum_time(F.col("date_created"))
    rows = records.withColumn("_dt", time).withColumn(
        "_record", F.when(F.char_length(F.coalesce("permalink", F.lit(""))) > 0, F.col("permalink")).otherwise(F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    )
    rows = keep_first(rows, [*keys, "_record"], [F.col("_dt"), F.col("permalink"), F.col("row_id")])
    rows = rows.withColumn("_author", F.coalesce("author_key", F.concat(F.lit("unkeyed:"), F.col("row_id").cast("string"))))
    others = [c for c in records.columns if c not in (*keys, "report", "treatments_mentioned")]
    order = F.struct(F.col("_dt").isNull(), F.col("_dt"), F.col("permalink").isNull(), F.col("permalink"), F.col("row_id"), F.col("report"))
    grouped = rows.groupBy(*keys, "_author").agg(
        F.min_by(F.struct(*others), order).alias("_first"),
        F.array_sort(F.collect_list(order)).alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.coalesce("treatments_mentioned", F.array().cast("array<string>"))))))).alias("treatments_mentioned"),
        F.count("*").alias("source_record_count"),
    )
    section = F.transform("_all", lambda r, k: F.concat(F.lit(SECTION), (k + 1).cast("string"), F.lit("\n\n"), F.coalesce(r["report"], F.lit(""))))
    body = F.array_join(section, SEPARATOR)
    head = F.when(F.col("_first.author_key").isNotNull(), F.concat(F.lit(AUTHOR_HEADER + "\n\n"), body)).otherwise(body)
    return grouped.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others], "treatments_mentioned", head.alias("report"), "source_record_count")
