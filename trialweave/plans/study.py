"""Registry records to a study: funnel, condition match, split, ground truth and what is counted about it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import trials
from trialweave.operators.relational import keep_first


@dataclass
class Study:
    trials: DataFrame  # nct_id, title, date, split
    truth_apo: DataFrame
    truth_ate: DataFrame
    covariates: DataFrame  # nct_id, title
    funnel: DataFrame


def build(records: DataFrame, conditions: list[str], ratio: float = 0.8, effects: bool = False) -> Study:
    """The study of some conditions. With `effects`, a trial needs two active arms."""
    steps = trials.trial_steps(2 if effects else 1)
    flagged = trials.funnel(records, steps)
    p = "protocolSection"
    none = F.array().cast("array<string>")
    terms = F.concat(
        *[F.coalesce(F.transform(f"derivedSection.conditionBrowseModule.{k}", lambda m: m["term"]), none) for k in ("meshes", "ancestors")],
        F.coalesce(f"{p}.conditionsModule.conditions", none),
    )
    chosen = flagged.where(F.col("valid") & trials.matches_condition(terms, F.lit(conditions)))
    date = F.coalesce(f"{p}.statusModule.resultsFirstPostDateStruct.date", f"{p}.statusModule.completionDateStruct.date")
    listed = chosen.select(F.col(f"{p}.identificationModule.nctId").alias("nct_id"), F.col(f"{p}.identificationModule.officialTitle").alias("title"), date.alias("date"))
    truth = trials.truth(chosen)
    effects_df = trials.pairs(truth, ["nct_id", "outcome"], "arm_order", "arm", "apo")
    measures = chosen.select(
        F.col(f"{p}.identificationModule.nctId").alias("nct_id"),
        F.explode(F.concat(
            F.coalesce(F.transform("resultsSection.baselineCharacteristicsModule.measures", lambda m: m["title"]), none), F.array(F.lit("Country"), F.lit("Duration")),
        )).alias("title"),
    ).distinct()
    labelled = listed.join((effects_df if effects else truth).select("nct_id").distinct(), "nct_id", "left_semi")
    split = trials.temporal_split(keep_first(labelled, ["nct_id"], [F.col("date")]), "date", "nct_id", ratio)
    return Study(split, truth, effects_df, measures, trials.funnel_counts(flagged, list(steps)))


def counts(study: Study) -> DataFrame:
    """Distinct trials, arms and outcomes by split, and the labels there are."""
    joined = study.trials.select("nct_id", "split").join(study.truth_apo, "nct_id")
    return joined.groupBy("split").agg(
        F.count_distinct("nct_id").alias("trials"), F.count_distinct("arm").alias("arms"), F.count_distinct("outcome").alias("outcomes"), F.count("*").alias("labels")
    )



def unique_trials(studies: list[Study]) -> DataFrame:
    """Distinct trials by split over several studies."""
    rows = [x.trials.select("split", "nct_id") for x in studies]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("split").agg(F.count_distinct("nct_id").alias("trials"))


def save(study: Study, path: str) -> None:
    for name in ("trials", "truth_apo", "truth_ate", "covariates", "funnel"):
        getattr(study, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> Study:
    return Study(*[spark.read.parquet(f"{path}/{name}") for name in ("trials", "truth_apo", "truth_ate", "covariates", "funnel")])
