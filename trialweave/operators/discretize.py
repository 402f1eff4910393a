"""Covariates to codes, by data-dependent rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(value: Column, imputed: Column) -> Column:
    """The value, or its imputation where it is missing, blank or unknown; both as text."""
    text = value.cast("string")
    return F.when(text.isNull() | F.lower(text).isin("unknown", ""), imputed.cast("string")).otherwise(text)


def first_seen_codes(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, code: codes from 0 in the order of the first row with the value."""
    seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return seen.select(value, (F.row_number().over(Window.orderBy("_first", value)) - 1).alias("code"))


def numeric_share(value: str) -> Column:
    return F.count(F.col(value).try_cast("double")) / F.count(F.lit(1))


def exact_median(df: DataFrame, value: str, most: int = 1_000_000) -> float | None:
    """The median of a column's numbers, the mean of the two middle ones; None without numbers.

    Quantile sketches narrow the range around the middle until at most `most` rows are left, on which it is exact. No
    task ever holds more than those.
    """
    v = F.col("v")
    data = df.select(F.col(value).try_cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n = data.count()
    if not n:
        return None
    first, last = (n - 1) // 2, n // 2
    below, inside = 0, n
    while inside > most:
        around = [max(0.0, (first - below) / inside - 0.002), min(1.0, (last - below) / inside + 0.002)]
        low, high = data.agg(F.percentile_approx(v, around, 10_000)).first()[0]
        if low == high:
            return low
        under, within = data.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
        if not below + under <= first <= last < below + under + within or within == inside:
            break  # so many equal values that sketches cannot part them: counts by value can
        data, below, inside = data.where(v.between(low, high)), below + under, within
    if inside > most:
        data = data.groupBy("v").count()
        total = F.sum("count").over(Window.orderBy("v"))
        hit = data.withColumn("t", total + below).where(F.col("t") > first).orderBy("v").limit(2).collect()
        return hit[0].v if hit[0].t > last else (hit[0].v + hit[1].v) / 2
    share = ((first + last) / 2 - below) / max(inside - 1, 1)
    return data.agg(F.percentile("v", F.lit(share))).first()[0]


def median_codes(df: DataFrame, value: str) -> DataFrame:
    """df with `code`, 1 above the exact median of its numbers and else 0 (text without a number too), and `median`."""
    median = exact_median(df, value)
    v = F.col(value).try_cast("double")
    return df.withColumn("code", F.coalesce((v > F.lit(median)).cast("int"), F.lit(0))).withColumn("median", F.lit(median).cast("double"))


def head_categories(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, n, code, label: frequent categories keep a code of their own up to the first whose count the tail does not exceed.

    Codes run by falling count, ties by first sight; what comes after the cut is one category, Other, with the last code.
    The window runs over one row for each category, never over the rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    by = Window.orderBy(F.desc("n"), "_first", value)
    tail = F.sum("n").over(Window.partitionBy()) - F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_rank", F.row_number().over(by) - 1).withColumn("_tail", tail)
    cut = F.min(F.when(F.col("_tail") <= F.col("n"), F.col("_rank"))).over(Window.partitionBy())
    placed = placed.withColumn("_cut", cut)
    kept = F.col("_rank") <= F.col("_cut")
    return placed.select(
        value, "n",
        F.when(kept, F.col("_rank")).otherwise(F.col("_cut") + 1).cast("int").alias("code"),
        F.when(kept, F.col(value)).otherwise(F.lit("Other")).alias("label"),
    )


def discretize(df: DataFrame, value: str, order: str) -> tuple[DataFrame, list[str]]:
    """df with `<value>_discretized`, and the options in code order: few values, numbers and categories each in their way."""
    out = f"{value}_discretized"
    stats = df.agg(F.count_distinct(value).alias("k"), numeric_share(value).alias("share")).first()
    if stats.k > 2 and (stats.share or 0) > 0.8:
        coded = median_codes(df, value)
        m = coded.select("median").first()
        text = f"{m.median:g}" if m else "0"
        return coded.withColumnRenamed("code", out).drop("median"), [f"Less than or equal to {text}", f"Greater than {text}"]
    codes = first_seen_codes(df, value, order).withColumn("label", F.col(value)) if stats.k <= 2 else head_categories(df, value, order)
    options = [r.label for r in codes.select("code", "label").distinct().orderBy("code").collect()]
    if stats.k > 2 and "Other" not in options:
        options.append("Other")
    return df.join(codes.select(value, F.col("code").alias(out)), value, "left"), options


def outcome_code(value: Column, binary: bool) -> Column:
    """No and Yes as 0 and 1; other outcomes as numbers, NULL for what is none."""
    if binary:
        return F.when(F.lower(value) == "no", 0.0).when(F.lower(value) == "yes", 1.0)
    return value.try_cast("double")


def treatment_codes(df: DataFrame, treatment: str, arms: list[str]) -> DataFrame:
    """df with `<treatment>_discretized`, the arm's place in the list; a treatment that is no arm raises when it is met."""
    place = F.array_position(F.lit(arms), F.col(treatment)) - 1
    checked = F.when(place >= 0, place.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no such arm: "), F.coalesce(F.col(treatment), F.lit("NULL")))).cast("int"))
    return df.withColumn(f"{treatment}_discretized", checked)
