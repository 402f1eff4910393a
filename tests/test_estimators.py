import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.operators import discretize as D
from trialweave.operators import estimators as E
from trialweave.plans import estimate

TRUE_ATE = 0.2
P_Y = {(0, 0): 0.6, (0, 1): 0.8, (1, 0): 0.2, (1, 1): 0.4}


def confounded(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, n)
    t = (rng.random(n) < np.where(x == 1, 0.8, 0.2)).astype(int)
    y = (rng.random(n) < np.vectorize(lambda a, b: P_Y[a, b])(x, t)).astype(float)
    return spark.createDataFrame([("k", int(a), int(b), float(c), i) for i, (a, b, c) in enumerate(zip(x, t, y))], "trial string, x int, t int, y double, id long")


def values(df, value="apo"):
    return {r.arm: r[value] for r in df.collect()}


def test_horvitz_thompson_cells(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 0.0])] * 2 + [(1, [0.0, 0.0, 0.0, 1.0])] * 2, "c int, p array<double>")
    got = E.ipw_responses(df, [], ["c"], "p", 2).orderBy("c").collect()
    assert [[r.responses[t] for r in got] for t in (0, 1)] == [[1, 1, 0, 0], [0, 0, 1, 1]]


def test_outcome_imputation_cells_and_missing_support(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 1.0]), (0, 1, [1.0, 0.0]), (1, 0, [0.5, 0.5]), (1, 1, [0.0, 1.0])], "c int, t int, p array<double>")
    got = E.oi_responses(df, [], ["c"], "t", "p", 2).orderBy("c", "t").collect()
    assert [[r.responses[t] for r in got] for t in (0, 1)] == [[1, 1, 0.5, 0.5], [0, 0, 1, 1]]
    short = E.potential_outcomes(E.oi_responses(df.where("not (c = 1 and t = 1)"), [], ["c"], "t", "p", 2), [], 2)
    assert values(short)[1] is None and values(short)[0] is not None


def test_exact_conditionals_recover_the_truth(spark):
    rows = [(0, [0.32, 0.48, 0.04, 0.16]), (1, [0.16, 0.04, 0.48, 0.32])] * 5
    apo = values(E.potential_outcomes(E.ipw_responses(spark.createDataFrame(rows, "c int, p array<double>"), [], ["c"], "p", 2), [], 2))
    assert apo[0] == pytest.approx(0.4) and apo[1] == pytest.approx(0.6)


@pytest.mark.parametrize("method", ["ipw", "oi", "mc_ipw", "mc_oi"])
def test_confounding_is_corrected(spark, method):
    df = confounded(spark, 4000, 1)
    if method == "ipw":
        df = df.join(E.cell_probabilities(df, ["trial"], ["x"], "t", "y", 2).drop("n"), ["trial", "x"]).withColumnRenamed("probs", "p")
    else:
        df = df.withColumn("p", F.array(1 - F.col("y"), F.col("y")))
    if method == "ipw":
        apo = E.potential_outcomes(E.ipw_responses(df, ["trial"], ["x"], "p", 2), ["trial"], 2)
        ate = E.treatment_effects(apo, ["trial"]).first().ate
    else:
        row = estimate.estimate(df.withColumnRenamed("p", "probs"), method, ["trial"], ["x"], "t", "y", 2, ["id"], replicates=4, effects=True).first()
        ate = row.pred
        assert row.ci_lower < row.pred < row.ci_upper
    naive = values(E.naive_means(df, ["trial"], "t", "y"))
    assert abs(naive[1] - naive[0] - TRUE_ATE) > 0.15
    assert abs(ate - TRUE_ATE) < 0.1


def test_hajek_weights_and_absent_arms(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0), (1, 4.0), (1, 4.0)], "t int, y double").withColumn("w", F.lit(2.0))
    apo = values(E.potential_outcomes(E.observed_responses(df, "t", "y", "w", 3), [], 3, weights="weights"))
    assert apo == {0: 2.0, 1: 4.0, 2: None}
    more = df.union(spark.createDataFrame([(1, 4.0, 2.0)] * 16, "t int, y double, w double"))
    assert values(E.potential_outcomes(E.observed_responses(more, "t", "y", "w", 3), [], 3, weights="weights"))[0] == 2.0


def test_inclusion_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.5), ([3.0, 4.0], 0.1), ([5.0, 6.0], 0.9)], "responses array<double>, w double")
    apo = values(E.potential_outcomes(df, [], 2, F.col("w")))
    assert apo[0] == pytest.approx((0.5 + 0.3 + 4.5) / 1.5)
    assert values(E.potential_outcomes(df.withColumn("w", F.lit(0.0)), [], 2, F.col("w"))) == {0: None, 1: None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(0.01, 100))
def test_weights_are_relative(spark, scale):
    df = spark.createDataFrame([([1.0], 0.5), ([3.0], 0.1)], "responses array<double>, w double")
    assert values(E.potential_outcomes(df, [], 1, F.col("w") * scale))[0] == pytest.approx(0.8 / 0.6)


def test_propensities_of_a_cell_sum_to_one(spark):
    df = confounded(spark, 500, 2)
    got = E.propensity(df.join(E.cell_probabilities(df, [], ["x"], "t", "y", 2).drop("n"), "x"), [], ["x"], "probs", 2).collect()
    assert all(sum(r.prop) == pytest.approx(1) for r in got)


def test_single_arm(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("b", 0, 0, 1.0), ("b", 1, 1, 3.0)], "trial string, x int, t int, y double")
    got = {(r.trial, r.x): r.weight for r in E.logistic_weights(df, ["trial"], ["x"], "t", 2).collect()}
    assert got["a", 0] is got["a", 1] is None and got["b", 0] > 1 and got["b", 1] > 1
    rows = E.linear_responses(df.where("trial = 'a'"), [], ["x"], "t", "y", 2).collect()
    assert all(np.isfinite(r.responses[0]) and r.responses[1] is None for r in rows)


def test_logistic_weights_are_inverse_probabilities(spark):
    got = E.logistic_weights(confounded(spark, 3000, 3), [], ["x"], "t", 2).groupBy("x", "t").agg(F.avg("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1 / (0.8 if r.x == r.t else 0.2), rel=0.15) for r in got)


@pytest.mark.parametrize("cells", [E.CELLS, 1])
def test_each_trial_has_its_own_models(spark, monkeypatch, cells):
    """Two trials with opposite assignment, together as alone, whether tasks or Spark's iterations fit them."""
    monkeypatch.setattr(E, "CELLS", cells)
    one = confounded(spark, 800, 5).select("x", "t", "y").withColumn("trial", F.lit("a"))
    two = confounded(spark, 800, 6).select((1 - F.col("x")).alias("x"), "t", "y").withColumn("trial", F.lit("b"))
    for method in ("mc_ipw", "mc_oi"):
        point = lambda df: {
            (r.trial, r.arm): r.apo
            for r in E.potential_outcomes(estimate.responses(df, method, ["trial"], ["x"], "t", "y", 3), ["trial"], 3, weights="weights" if method == "mc_ipw" else None).collect()  # noqa: B023
        }
        both, alone = point(one.unionByName(two)), point(one) | point(two)
        assert both.keys() == alone.keys() and len(both) == 6
        assert all(both[k] == pytest.approx(alone[k], abs=1e-6) if k[1] < 2 else both[k] is alone[k] is None for k in both)


def test_rows_with_missing_covariates_can_go(spark):
    df = spark.createDataFrame([(0, 1), (None, 1), (1, None)], "a int, b int")
    assert estimate.complete(df, ["a"]).count() == 3 and estimate.complete(df, ["a"], use_imputed_nones=False).count() == 2


def test_bootstrap_draws_n_of_n_in_each_stratum(spark):
    df = confounded(spark, 300, 4)
    sizes = {(r.trial, r.t): r["count"] for r in df.groupBy("trial", "t").count().collect()}
    drawn = E.bootstrap(df, ["trial"], ["id"], 3, 1, ["t"]).groupBy("replicate", "trial", "t").agg(F.sum("times").alias("n"), F.count("*").alias("k")).collect()
    assert len(drawn) == 6 and all(r.n == sizes[r.trial, r.t] and r.k < r.n for r in drawn)


def test_interval_is_null_with_a_null_replicate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k string, apo double")
    got = {r.k: r.sd for r in E.interval(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(2**0.5) and got["b"] is None


def test_validation(spark):
    df = spark.createDataFrame([(1, None)], "x int, y double")
    with pytest.raises(ValueError, match="y"):
        E.validated(df, ["x", "y"])
    with pytest.raises(ValueError, match="binary"):
        estimate.responses(df, "ipw", [], ["x"], "t", "y", 2, binary=False)


def codes(spark, items, imputed=None):
    rows = [(i, v, (imputed or items)[i]) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, "o long, raw string, imp string").withColumn("v", D.resolved(F.col("raw"), F.col("imp")))
    out, options = D.discretize(df, "v", "o")
    return [r.v_discretized for r in out.orderBy("o").collect()], options


def test_discretisation(spark):
    assert codes(spark, ["USA", "UK", "USA"]) == ([0, 1, 0], ["USA", "UK"])
    assert codes(spark, ["USA", "Unknown"], ["USA", "UK"])[0] == [0, 1]
    got, options = codes(spark, ["10", "20", "30", "40", "Unknown"], ["10", "20", "30", "40", "25"])
    assert got == [0, 0, 1, 1, 0] and options[1] == "Greater than 25"
    assert codes(spark, ["USA", "USA", "USA", "UK", "France", "Spain"]) == ([0, 0, 0, 1, 1, 1], ["USA", "Other"])


def test_treatment_codes_raise_on_strangers(spark):
    df = spark.createDataFrame([("A",), ("B",)], "treatment string")
    assert [r.treatment_discretized for r in D.treatment_codes(df, "treatment", ["A", "B"]).collect()] == [0, 1]
    with pytest.raises(Exception, match="no such arm"):
        D.treatment_codes(df, "treatment", ["A"]).collect()


@pytest.mark.parametrize("method", ["ipw", "oi"])
def test_sums_of_cells_equal_individual_responses(spark, method):
    df = confounded(spark, 400, 6).withColumn("probs", F.array(0.2 + F.col("x") / 10, 0.3 - F.col("y") / 10, F.rand(1) / 5, F.rand(2) / 5) if method == "ipw" else F.array(1 - F.col("y"), F.col("y")))
    df = df.withColumn("w", F.rand(3))
    if method == "ipw":
        a = E.ipw_potential_outcomes(df, ["trial"], ["x"], "probs", 2, F.col("w"))
        b = E.potential_outcomes(E.ipw_responses(df, ["trial"], ["x"], "probs", 2), ["trial"], 2, F.col("w"))
    else:
        a = E.oi_potential_outcomes(df, ["trial"], ["x"], "t", "probs", 2, F.col("w"))
        b = E.potential_outcomes(E.oi_responses(df, ["trial"], ["x"], "t", "probs", 2), ["trial"], 2, F.col("w"))
    assert values(a) == pytest.approx(values(b))


@pytest.mark.parametrize("most", [10**6, 40, 3])
def test_exact_median(spark, most):
    rng = np.random.default_rng(5)
    for x in (rng.random(401), rng.random(400), np.round(rng.random(300), 1), np.zeros(50), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(str(v),) for v in x] + [("no number",), (None,)], "v string")
        assert D.exact_median(df, "v", most) == pytest.approx(np.median(x))
    assert D.exact_median(spark.createDataFrame([("x",)], "v string"), "v") is None
