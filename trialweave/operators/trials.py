"""Trials: eligibility funnel, condition matching, temporal split and ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import text as T
from trialweave.functions import values as V

ACTIVE = ("ACTIVE_COMPARATOR", "EXPERIMENTAL")  # fixed values of the registry
CONTROL = ("NO_INTERVENTION", "PLACEBO_COMPARATOR", "SHAM_COMPARATOR")


def is_active(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ACTIVE), F.lit(False))


def is_not_control(kind: Column) -> Column:
    return ~F.coalesce(kind.isin(*CONTROL), F.lit(False))


def funnel(trials: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """trials with one flag for each step, true if it and all before it hold, and `valid`."""
    so_far, out = F.lit(True), trials
    for name, condition in steps.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        out = out.withColumn(name, so_far)
    return out.withColumn("valid", so_far)


def funnel_counts(flagged: DataFrame, steps: Sequence[str]) -> DataFrame:
    return flagged.agg(*[F.count_if(s).alias(s) for s in steps], F.count("*").alias("trials"))


def trial_steps(arms_needed: int = 1, randomized: bool = True, parallel: bool = True, ill: bool = True, binary: bool = True) -> dict[str, Column]:
    """The funnel over registry records; a step that is switched off passes."""
    design = "protocolSection.designModule.designInfo"
    arms = F.coalesce(F.col("protocolSection.armsInterventionsModule.armGroups"), F.array())
    outcomes = F.coalesce(F.col("protocolSection.outcomesModule.primaryOutcomes"), F.array())
    healthy = F.col("protocolSection.eligibilityModule.healthyVolunteers")
    on = lambda flag, c: c if flag else F.lit(True)
    return {
        "randomized": on(randomized, F.col(f"{design}.allocation") == "RANDOMIZED"),
        "parallel": on(parallel, F.col(f"{design}.interventionModel") == "PARALLEL"),
        "arms": F.size(F.filter(arms, lambda a: is_active(a["type"]))) >= arms_needed,
        "ill": on(ill, F.col("protocolSection.eligibilityModule").isNotNull() & ~F.coalesce(healthy, F.lit(False))),
        "binary": on(binary, F.exists(outcomes, lambda o: T.is_binary_endpoint(o["measure"]))),
    }


def matches_condition(terms: Column, conditions: Column) -> Column:
    """Does any term contain any condition, or the other way round? Both lower-cased, underscores as blanks."""
    low = lambda a: F.transform(a, lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.exists(low(terms), lambda t: F.exists(low(conditions), lambda c: F.contains(t, c) | F.contains(c, t))), F.lit(False))


def temporal_split(trials: DataFrame, date: str, key: str, ratio: float = 0.8) -> DataFrame:
    """trials with `split`: the earliest share is train, the rest val; undated ones come last, ties are broken by key.

    The date at the cut comes from counts by date, one narrow row for each; only trials of that very date are ranked.
    """
    order = [F.col(date).isNull(), F.col(date)]
    counts = trials.groupBy(date).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(*order)))
    total = trials.count()
    k = int(total * ratio)
    cut = upto.where(F.col("upto") >= k).orderBy(*order).first() if k else None
    if cut is None:
        return trials.withColumn("split", F.lit("val"))
    at = F.col(date).eqNullSafe(F.lit(cut[date]))
    before = F.col(date).isNotNull() & (F.lit(True) if cut[date] is None else F.col(date) < F.lit(cut[date]))
    tied = trials.where(at).select(F.col(key).alias("_k"), (F.row_number().over(Window.orderBy(key)) <= k - (cut.upto - cut.n)).alias("_in"))
    early = tied.where("_in").select("_k").distinct()
    inside = trials.where(at).join(early, trials[key] == early["_k"], "left").withColumn("split", F.when(F.col("_k").isNotNull(), "train").otherwise("val"))
    rest = trials.where(~at).withColumn("split", F.when(before, "train").otherwise("val"))
    return rest.unionByName(inside.drop("_k"))


def pairs(arms: DataFrame, keys: Sequence[str], order: str, name: str, value: str) -> DataFrame:
    """Keys, name_i, name_j, effect for arms i before j of one outcome, unless their plain names coincide."""
    item = F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(value).alias("v"), T.normalize_treatment(F.col(name)).alias("p"))
    grouped = arms.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    first = grouped.select(*keys, "_a", F.explode("_a").alias("_i"))
    both = first.select(*keys, "_i", F.explode(F.filter("_a", lambda x: (x.o > F.col("_i.o")) & (x.p != F.col("_i.p")))).alias("_j"))
    return both.select(*keys, F.col("_i.n").alias("arm_i"), F.col("_j.n").alias("arm_j"), (F.col("_j.v") - F.col("_i.v")).alias("effect"))


def truth(trials: DataFrame) -> DataFrame:
    """nct_id, outcome, arm_order, arm, apo, param, unit, dispersion bounds: ground truth of completed trials.

    A cohort counts if a protocol arm of its title is active. Its value is the first class's whose first category holds
    the cohort; its denominator stands in the first denominators, and is 0 without one.
    """
    sections = trials.select(
        F.col("protocolSection.identificationModule.nctId").alias("nct_id"),
        F.col("protocolSection.armsInterventionsModule.armGroups").alias("arms"),
        F.explode(F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")).alias("m"),
    ).where(F.col("m.type") == "PRIMARY")
    active = F.transform(F.filter(F.coalesce("arms", F.array()), lambda a: is_active(a["type"])), lambda a: a["label"])
    cohort = sections.select("nct_id", "m", active.alias("active"), F.posexplode("m.groups").alias("arm_order", "g"))
    cohort = cohort.where(F.array_contains("active", F.col("g.title")))
    of_group = lambda items: F.filter(items, lambda x: x["groupId"] == F.col("g.id"))
    found = F.get(
        F.filter(
            F.transform(F.coalesce("m.classes", F.array()), lambda c: F.get(of_group(F.get(c["categories"], F.lit(0))["measurements"]), F.lit(0))),
            lambda x: x.isNotNull(),
        ),
        F.lit(0),
    )
    denom = F.get(of_group(F.get(F.col("m.denoms"), F.lit(0))["counts"]), F.lit(0))["value"]
    spread = V.dispersion(F.col("m.dispersionType"), V.number(found["spread"]), V.number(found["lowerLimit"]), V.number(found["upperLimit"]))
    apo = V.normalized_outcome(V.number(found["value"]), V.number(F.coalesce(denom, F.lit("0"))), F.col("m.unitOfMeasure"), F.col("m.paramType"))
    rows = cohort.select(
        "nct_id", F.col("m.title").alias("outcome"), "arm_order", F.col("g.title").alias("arm"), apo.alias("apo"), F.col("m.paramType").alias("param"),
        F.col("m.unitOfMeasure").alias("unit"), spread.alias("bounds"), V.is_binary_outcome(F.col("m.paramType"), F.col("m.title")).alias("binary"),
    )
    from trialweave.operators.relational import keep_first

    return keep_first(rows.where(F.col("apo").isNotNull()), ["nct_id", "outcome", "arm"], [F.col("arm_order")])


def covariate_frequency(covariates: DataFrame, title: str, order: str) -> DataFrame:
    """Titles by falling count, ties in the order in which they were first seen."""
    return covariates.groupBy(title).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
