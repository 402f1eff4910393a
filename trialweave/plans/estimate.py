"""Curated and extracted rows to potential outcomes, effects, intervals and errors: all trials in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators import estimators as E
from trialweave.operators import results as R


def sized(df: DataFrame, keys: Sequence[str], most: int = 100_000) -> DataFrame:
    """Rows of trials with at most so many rows; larger ones are skipped whole."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return df.join(n.select(*keys), list(keys), "left_semi")


def complete(df: DataFrame, covs: Sequence[str], use_imputed_nones: bool = True) -> DataFrame:
    """Rows to estimate from: all, or those alone that no covariate is missing in."""
    return df if use_imputed_nones else df.dropna(subset=list(covs))


def responses(df: DataFrame, method: str, keys: Sequence[str], covs: Sequence[str], t: str, y: str, arms: int, probs: str = "probs", binary: bool = True) -> DataFrame:
    if method in ("ipw", "oi") and not binary:
        raise ValueError(f"{method} takes binary outcomes only")
    if method == "ipw":
        return E.ipw_responses(df, keys, covs, probs, arms)
    if method == "oi":
        return E.oi_responses(df, keys, covs, t, probs, arms)
    if method == "mc_oi":
        return E.linear_responses(df, keys, covs, t, y, arms)
    if method == "mc_ipw":
        return E.observed_responses(E.logistic_weights(df, keys, covs, t, arms), t, y, "weight", arms)
    raise ValueError(f"unknown method {method}")


def estimate(
    df: DataFrame, method: str, keys: Sequence[str], covs: Sequence[str], t: str, y: str, arms: int, order: Sequence[str],
    inclusion: Column | None = None, replicates: int = 10, seed: int = 0, alpha: float = 0.05, effects: bool = False,
    use_imputed_nones: bool = True,
) -> DataFrame:
    """Keys, arm (or arm_i, arm_j), pred, half_width, ci_lower, ci_upper. Every replicate is fitted anew, all at once."""
    weights = "weights" if method == "mc_ipw" else None
    df = complete(df, covs, use_imputed_nones)

    def point(data: DataFrame, by: list[str], weight: Column | None) -> DataFrame:
        if method == "ipw":
            apo = E.ipw_potential_outcomes(data, by, covs, "probs", arms, weight)
        elif method == "oi":
            apo = E.oi_potential_outcomes(data, by, covs, t, "probs", arms, weight)
        else:
            apo = E.potential_outcomes(responses(data, method, by, covs, t, y, arms), by, arms, weight, weights=weights)
        return E.treatment_effects(apo, by).withColumnRenamed("ate", "apo") if effects else apo

    keys = list(keys)
    name = [*keys, *(["arm_i", "arm_j"] if effects else ["arm"])]
    whole = point(df, keys, inclusion).withColumnRenamed("apo", "pred")
    drawn = E.bootstrap(df, keys, order, replicates, seed, [t] if method.startswith("mc") else [])
    again = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_k", "times")
    many = point(again, [*keys, "replicate"], inclusion)
    return R.with_interval(whole, E.interval(many, name, "apo", alpha), name)
