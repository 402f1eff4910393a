"""Result rows: truth, errors, intervals, collection and series for plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators.relational import keep_first


def with_truth(estimates: DataFrame, truth: DataFrame, on: Sequence[str], predicted: str = "pred", true: str = "truth") -> DataFrame:
    """Estimates with the true value, if there is one, and the absolute error."""
    return estimates.join(truth, list(on), "left").withColumn("abs_error", F.abs(F.col(predicted) - F.col(true)))


def with_interval(estimates: DataFrame, intervals: DataFrame, on: Sequence[str], predicted: str = "pred") -> DataFrame:
    out = estimates.join(intervals, list(on), "left")
    return out.withColumns({"ci_lower": F.col(predicted) - F.col("half_width"), "ci_upper": F.col(predicted) + F.col("half_width")})


def collected(results: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key, those with an error alone, the wanted columns."""
    first = keep_first(results, keys, [F.col(c) for c in order])
    return first.where(F.col("abs_error").isNotNull()).select(*columns)


def forest_series(results: DataFrame, percent: bool = False) -> DataFrame:
    """Half widths to plot, and dispersion as a share where it is given in percent."""
    scale = 100.0 if percent else 1.0
    return results.withColumns({
        "low_error": F.col("pred") - F.col("ci_lower"), "high_error": F.col("ci_upper") - F.col("pred"), "dispersion": F.col("dispersion") / scale,
    }).orderBy("truth")


def over_thresholds(df: DataFrame, size: str, thresholds: Sequence[int] = (0, 10, 100, 1000, 10000, 50000)) -> DataFrame:
    return df.agg(*[F.count_if(F.col(size) > t).alias(f"over_{t}") for t in thresholds])


def mean_truth(truth: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, and mean absolute, true value of each trial."""
    return truth.groupBy(key).agg(F.avg(value).alias("mean_apo"), F.avg(F.abs(value)).alias("mean_abs_ate"))


def result_path(nct: str, experiment: str, model: str, kind: str, outcome: str = "") -> str:
    import re

    clean = lambda x: re.sub(r"[^\w\-.]", "_", x)
    return f"results/{clean(nct)}_{clean(experiment)}/{clean(model)}_{kind}{'_' + clean(outcome.lower()) if outcome else ''}"
