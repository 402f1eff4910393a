"""Command line: `python -m trialweave.plans.run study|curate|estimate ...`. Every step reads and writes Parquet folders."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F

from trialweave import session
from trialweave.plans import curate, estimate, study
from trialweave.sources import archives, registry


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trialweave")
    steps = out.add_subparsers(dest="step", required=True)
    s = steps.add_parser("study", help="registry documents to a study with ground truth")
    s.add_argument("--trials", required=True)
    s.add_argument("--conditions", nargs="+", required=True)
    s.add_argument("--ratio", type=float, default=0.8)
    s.add_argument("--effects", action="store_true", help="pairwise effects: two active arms needed")
    c = steps.add_parser("curate", help="archives to one report for each author and trial")
    c.add_argument("--archives", nargs="+", required=True)
    c.add_argument("--registry", required=True, help="Parquet with subreddit, alias, nct_id, cutoff")
    e = steps.add_parser("estimate", help="extracted rows to potential outcomes with intervals")
    e.add_argument("--rows", required=True)
    e.add_argument("--method", choices=("ipw", "oi", "mc_ipw", "mc_oi"), default="mc_oi")
    e.add_argument("--keys", nargs="+", default=["nct_id"])
    e.add_argument("--covariates", nargs="+", required=True)
    e.add_argument("--treatment", default="treatment_taken_discretized")
    e.add_argument("--outcome", default="outcome_category_discretized")
    e.add_argument("--arms", type=int, required=True)
    e.add_argument("--order", nargs="+", default=["row_id"])
    e.add_argument("--inclusion", help="column with the weight of each row")
    e.add_argument("--replicates", type=int, default=10)
    e.add_argument("--seed", type=int, default=0)
    e.add_argument("--alpha", type=float, default=0.05)
    e.add_argument("--effects", action="store_true")
    e.add_argument("--most-rows", type=int, default=100_000, help="larger trials are skipped")
    for step in (s, c, e):
        step.add_argument("--out", required=True)
    return out


def main(args: Sequence[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session.build()
    if a.step == "study":
        got = study.build(registry.read_trials(spark, a.trials), a.conditions, a.ratio, a.effects)
        study.save(got, a.out)
    elif a.step == "curate":
        records = curate.contextualize(archives.read_archives(spark, a.archives))
        curate.curate(records, spark.read.parquet(a.registry)).write.mode("overwrite").partitionBy("nct_id").parquet(a.out)
    else:
        rows = estimate.sized(spark.read.parquet(a.rows), a.keys, a.most_rows)
        weight = F.col(a.inclusion) if a.inclusion else None
        out = estimate.estimate(
            rows, a.method, a.keys, a.covariates, a.treatment, a.outcome, a.arms, a.order, weight, a.replicates, a.seed, a.alpha, a.effects
        )
        out.withColumn("estimator", F.lit(a.method)).write.mode("append").parquet(a.out)


if __name__ == "__main__":
    main()
