"""Dates, numbers, arrays and nested values."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of dates and parameters of outcomes as the sources write them.
FORUM_FORMATS = (
    "MMMM dd, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
)
COUNT_PARAMS = ("NUMBER", "COUNT_OF_PARTICIPANTS", "COUNT_OF_UNITS")


def forum_time(value: Column) -> Column:
    """The first format that fits, epoch seconds last; NULL where none does."""
    tries = [F.try_to_timestamp(value, F.lit(f)) for f in FORUM_FORMATS]
    return F.coalesce(*tries, F.timestamp_seconds(value.try_cast("double")))


def forum_date_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "MMMM dd, yyyy")


def trial_cutoff(value: Column) -> Column:
    """A trial's full date; anything else, months alone too, is no cut-off at all."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.lit("9999-12-31").cast("timestamp"))


def literature_date(value: Column) -> Column:
    """Publication dates: days, or months and years as their first day."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")])


def number(value: Column) -> Column:
    """Numbers in text, thousands separators dropped; NULL for anything else."""
    return F.regexp_replace(value, ",", "").try_cast("double")


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def normalized_outcome(value: Column, denominator: Column, unit: Column, param: Column) -> Column:
    """Percentages as shares, counts over their denominator, all else as it stands."""
    counted = F.coalesce(param, F.lit("")).isin(*COUNT_PARAMS)
    percent = F.contains(F.lower(F.coalesce(unit, F.lit(""))), F.lit("percent"))
    return F.when(percent, value / 100).when(counted, F.try_divide(value, denominator)).otherwise(value)


def is_binary_outcome(param: Column, title: Column) -> Column:
    from trialweave.functions.text import is_binary_endpoint

    return F.coalesce(param.isin(*COUNT_PARAMS), is_binary_endpoint(title))


def dispersion(kind: Column, spread: Column, lower: Column, upper: Column) -> Column:
    """(lower, upper) for confidence intervals, else the spread twice as (spread, NULL)."""
    interval = F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("confidence"))
    return F.when(interval, F.struct(lower.alias("lower"), upper.alias("upper"))).otherwise(
        F.struct(spread.alias("lower"), F.lit(None).cast("double").alias("upper"))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    shares = lambda e: _let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return _let(F.array_max(scores), lambda top: _let(F.transform(scores, lambda x: F.exp(x - top)), shares))


def expected_index(probs: Column) -> Column:
    """Sum of j * p_j over an array that starts with p_0."""
    return F.aggregate(F.transform(probs, lambda p, j: p * j), F.lit(0.0), lambda a, x: a + x)


def quantile(alpha: float) -> float:
    """The normal quantile of a two-sided interval."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts: the same in every engine, run and partitioning."""
    key = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
