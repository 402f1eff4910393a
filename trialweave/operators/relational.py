"""Joins, ranks and set operations that the rest is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def maybe_broadcast(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; else as it is, for the planner to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the order: an aggregate with partial combining, so no key meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.struct(o.isNull().alias("n"), o.alias("v")).alias(f"o{k}") for k, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", groups: int = 64) -> DataFrame:
    """A rank from 0 within keys. Big keys are dealt over hash groups, ranked there and shifted by the groups before.

    The order is total within a group and arbitrary but fixed between groups: enough to address rows by number.
    """
    g = F.pmod(F.xxhash64(*order), F.lit(groups))
    dealt = df.withColumn("_g", g)
    sizes = dealt.groupBy(*keys, "_g").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy(*keys).orderBy("_g")) - F.col("count")).drop("count")
    within = Window.partitionBy(*keys, "_g").orderBy(*order)
    return dealt.withColumn(name, F.row_number().over(within) - 1).join(before, [*keys, "_g"]).withColumn(name, F.col(name) + F.col("_before")).drop("_g", "_before")


def resumed(current: DataFrame, cached: DataFrame, key: str, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that still need work, finished rows of the current input): finished rows of other inputs stay out."""
    todo = current.join(cached.select(key), key, "left_anti")
    done = cached.join(current.select(key).distinct(), key, "left_semi")
    return todo, done if new is None else done.unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows win over new ones of the same key, and the first in order among equals."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.col("_p"), *map(F.col, order)]).drop("_p")


def combinations(options: dict[str, Sequence[str]], spark) -> DataFrame:
    """All answers to a fixed questionnaire, the last question varying fastest, numbered. The lists are configuration."""
    from itertools import product

    rows = [(k, *x) for k, x in enumerate(product(*options.values()))]
    return spark.createDataFrame(rows, ", ".join(["combo long", *[f"`{n}` string" for n in options]]))


def totals(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """Sums by key and over all, the whole as `total`."""
    out = df.rollup(key).agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("n"), F.grouping(key).alias("_all"))
    return out.withColumn(key, F.when(F.col("_all") == 1, "total").otherwise(F.col(key))).drop("_all")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def remaining(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the second lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def sorted_distinct(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in order; NULL is none."""
    return df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value)
