"""What runs leave behind: done markers, dataset paths and sizes, appended results, curated tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators.relational import keep_first

log = logging.getLogger(__name__)


def mark_done(files: DataFrame, manifest: str) -> None:
    """Adds the files to the manifest, a table: a marker stands there once its write has been committed, or not at all."""
    files.select("path", F.current_timestamp().alias("done_at")).write.mode("append").parquet(manifest)


def done(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.parquet(manifest).groupBy("path").agg(F.min("done_at").alias("done_at"))


def with_dataset(known: DataFrame, new: DataFrame) -> DataFrame:
    """source, nct_id, path, rows: what is new replaces what was known of the same trial and source."""
    both = new.withColumn("_p", F.lit(0)).unionByName(known.withColumn("_p", F.lit(1)))
    return keep_first(both, ["source", "nct_id"], [F.col("_p"), F.col("path")]).drop("_p")


def append_results(results: DataFrame, path: str, run: str) -> None:
    """Appends results below a folder for the run: one that is repeated replaces its own rows and no others."""
    results.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_by_trial(records: DataFrame, path: str, key: str = "nct_id") -> DataFrame:
    """A folder for each trial, its key in the folder's name alone, replaced whole when it is written again; returns the
    rows of each. A salt spreads a trial that holds much of the rows."""
    salt = F.pmod(F.xxhash64(*[c for c in records.columns if c != key]), F.lit(8))
    dealt = records.withColumn("_s", salt).repartition(key, "_s").drop("_s")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return counts_by(records.sparkSession.read.option("basePath", path).parquet(path), key)


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows"))


def read_curated(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A curated table, CSV where the path says so and Parquet else."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    return spark.read.parquet(path)


def data_count(text: Column) -> Column:
    """`data_count` of a dictionary as Python writes it; NULL for what is none."""
    return F.from_json(text, "data_count long").getField("data_count")


def literal_list(text: Column) -> Column:
    """A list of texts as Python writes it; NULL counts as an empty list."""
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("[]")), "array<string>"), F.array().cast("array<string>"))


def trial_filters(given: Mapping, effects: bool) -> dict:
    """The filters with the number of arms that the estimate needs, where none is given; another one is kept, and told."""
    needed = 2 if effects else 1
    out = dict(given)
    if out.get("num_noncontrol") is None:
        out["num_noncontrol"] = needed
    elif out["num_noncontrol"] != needed:
        log.warning("num_noncontrol is %s, the estimate needs %s", out["num_noncontrol"], needed)
    return out


def first_given(settings: Mapping, *names: str):
    """The first of the (dotted) settings that has a value; None where none has."""
    for name in names:
        at = settings
        for part in name.split("."):
            at = at.get(part) if isinstance(at, Mapping) else None
        if at is not None:
            return at
    return None


#: The order in which a dashboard lists the stages' files.
STAGE_ORDER = ("ty_filter", "knowns", "imputations", "sample_ty", "inclusion", "ty_given_x")


def stage_of(file: Column) -> Column:
    """The stage that a file's name tells, NULL for none."""
    bare = F.regexp_replace(file, r"\.[^.]*$", "")
    return F.coalesce(*[F.when(F.contains(bare, F.lit(f"_{s}_")), s) for s in STAGE_ORDER])


def stage_rank(stage: Column) -> Column:
    """The stage's place in the order; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(STAGE_ORDER)), stage), F.lit(0)) - 1, F.lit(len(STAGE_ORDER))).cast("int")
