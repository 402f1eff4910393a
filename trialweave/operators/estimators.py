"""Causal estimators, each as one grouped job over all trials at once.

`keys` are the columns that set a trial, source and outcome apart; covariates are columns of codes; arms are 0..n-1.
NULL stands for what has no support.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trialweave.functions.values import draw, quantile
from trialweave.operators.relational import ranked


def cell_probabilities(df: DataFrame, keys: Sequence[str], covs: Sequence[str], t: str, y: str, arms: int) -> DataFrame:
    """Keys, covariates, n and probs: P(T, Y | X) from frequencies, at index 2 t + y."""
    cells = [F.count_if((F.col(t) == a) & (F.col(y) == b)) / F.count("*") for a in range(arms) for b in (0, 1)]
    return df.groupBy(*keys, *covs).agg(F.count("*").alias("n"), F.array(*cells).alias("probs"))


def _same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal columns, NULL being equal to NULL, as cells of a covariate can be."""
    right = b.select(*[F.col(c).alias(f"_r{k}") if c in on else F.col(c) for k, c in enumerate(b.columns)])
    names = {c: f"_r{k}" for k, c in enumerate(b.columns) if c in on}
    cond = F.lit(True)
    for c in on:
        cond = cond & a[c].eqNullSafe(right[names[c]])
    return a.join(right, cond, how).drop(*names.values())


def propensity(df: DataFrame, keys: Sequence[str], covs: Sequence[str], probs: str, arms: int) -> DataFrame:
    """Mean of P(t, 0) + P(t, 1) for each observed cell; cells that nobody is in are never enumerated."""
    p = F.col(probs)
    return df.groupBy(*keys, *covs).agg(F.array(*[F.avg(p[2 * t] + p[2 * t + 1]) for t in range(arms)]).alias("prop"))


def ipw_responses(df: DataFrame, keys: Sequence[str], covs: Sequence[str], probs: str, arms: int) -> DataFrame:
    """df with `responses`: for each arm P(t, Y=1) over the cell's propensity, 0 where that is 0."""
    joined = _same(df, propensity(df, keys, covs, probs, arms), [*keys, *covs])
    p, q = F.col(probs), F.col("prop")
    return joined.withColumn("responses", F.array(*[F.when(q[t] > 0, p[2 * t + 1] / q[t]).otherwise(0.0) for t in range(arms)])).drop("prop")


def oi_responses(df: DataFrame, keys: Sequence[str], covs: Sequence[str], t: str, probs: str, arms: int) -> DataFrame:
    """df with `responses`: for each arm the mean of sum(j p_j) over the cell's rows of that arm; NULL without such rows."""
    value = F.aggregate(F.transform(F.col(probs), lambda p, j: p * j), F.lit(0.0), lambda a, x: a + x)
    cells = df.groupBy(*keys, *covs).agg(F.array(*[F.avg(F.when(F.col(t) == a, value)) for a in range(arms)]).alias("responses"))
    return _same(df, cells, [*keys, *covs])


def potential_outcomes(df: DataFrame, keys: Sequence[str], arms: int, weight: Column | None = None, responses: str = "responses", weights: str | None = None) -> DataFrame:
    """Keys, arm and apo: sum(r w) / sum(w) for each arm, w being the inclusion weight times the response's own.

    One row without support makes its arm NULL, as does a weight of zero in all.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    aggs = []
    for t in range(arms):
        r = F.col(responses)[t]
        v = w * (F.col(weights)[t] if weights else F.lit(1.0))
        mean = F.try_divide(F.sum(r * v), F.nullif(F.sum(v), F.lit(0.0)))
        aggs.append(F.when(F.count_if(r.isNull() & v.isNotNull()) == 0, mean).alias(f"_a{t}"))
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.posexplode(F.array(*[f"_a{t}" for t in range(arms)])).alias("arm", "apo"))


def _by_trial(cells: DataFrame, keys: Sequence[str], values: list[Column]) -> DataFrame:
    wide = cells.groupBy(*keys).agg(*[v.alias(f"_a{t}") for t, v in enumerate(values)])
    return wide.select(*keys, F.posexplode(F.array(*[f"_a{t}" for t in range(len(values))])).alias("arm", "apo"))


def ipw_potential_outcomes(df: DataFrame, keys: Sequence[str], covs: Sequence[str], probs: str, arms: int, weight: Column | None = None) -> DataFrame:
    """Keys, arm and apo, as from `ipw_responses` and `potential_outcomes`, but from sums of the cells alone.

    One pass over the rows and one shuffle of partial sums for each cell: no row is joined back to its cell.
    """
    w, p = F.lit(1.0) if weight is None else weight.cast("double"), F.col(probs)
    cells = df.groupBy(*keys, *covs).agg(
        *[F.avg(p[2 * t] + p[2 * t + 1]).alias(f"q{t}") for t in range(arms)], *[F.sum(w * p[2 * t + 1]).alias(f"s{t}") for t in range(arms)], F.sum(w).alias("w")
    )
    total = F.nullif(F.sum("w"), F.lit(0.0))
    return _by_trial(cells, keys, [F.sum(F.when(F.col(f"q{t}") > 0, F.col(f"s{t}") / F.col(f"q{t}")).otherwise(0.0)) / total for t in range(arms)])


def oi_potential_outcomes(df: DataFrame, keys: Sequence[str], covs: Sequence[str], t: str, probs: str, arms: int, weight: Column | None = None) -> DataFrame:
    """Keys, arm and apo, as from `oi_responses` and `potential_outcomes`, from sums of the cells alone."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    value = F.aggregate(F.transform(F.col(probs), lambda p, j: p * j), F.lit(0.0), lambda a, x: a + x)
    cells = df.groupBy(*keys, *covs).agg(*[F.avg(F.when(F.col(t) == a, value)).alias(f"m{a}") for a in range(arms)], F.sum(w).alias("w"))
    total = F.nullif(F.sum("w"), F.lit(0.0))
    return _by_trial(cells, keys, [F.when(F.count_if(F.col(f"m{a}").isNull()) == 0, F.sum(F.col("w") * F.col(f"m{a}")) / total) for a in range(arms)])


def treatment_effects(apo: DataFrame, keys: Sequence[str], arm: str = "arm", value: str = "apo") -> DataFrame:
    """Keys, arm_i, arm_j and ate = value_j - value_i for every i < j: arms of one trial are few, so they meet in an array."""
    arms = apo.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(arm).alias("k"), F.col(value).alias("v")))).alias("_a"))
    first = arms.select(*keys, "_a", F.posexplode("_a").alias("_i", "_x"))
    pair = first.select(*keys, "_x", F.explode(F.filter("_a", lambda e: e.k > F.col("_x.k"))).alias("_y"))
    return pair.select(*keys, F.col("_x.k").alias("arm_i"), F.col("_y.k").alias("arm_j"), (F.col("_y.v") - F.col("_x.v")).alias("ate"))


def naive_means(df: DataFrame, keys: Sequence[str], t: str, y: str) -> DataFrame:
    return df.groupBy(*keys, F.col(t).alias("arm")).agg(F.avg(y).alias("apo"))


def linear_responses(df: DataFrame, keys: Sequence[str], covs: Sequence[str], t: str, y: str, arms: int) -> DataFrame:
    """Outcome imputation: least squares of y on covariates and t as one number, predicted for every arm that the key's rows
    have; NULL for the others.

    The normal equations of all keys come from one aggregate, and executors solve them, one small system for each key; a
    solution of smallest norm serves constant columns.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covs], F.col(t).cast("double")]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(y)).alias(f"y{i}") for i in range(k)]
    seen = F.array(*[F.count_if(F.col(t) == a) > 0 for a in range(arms)]).alias("_seen")
    systems = df.groupBy(*keys).agg(*sums, seen)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            beta = []
            for r in frame.to_dict("records"):
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                beta.append(np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(k)], float), rcond=None)[0].tolist())
            yield frame[[*keys, "_seen"]].assign(_beta=beta)

    kept = S.StructType([*[df.schema[c] for c in keys], S.StructField("_seen", S.ArrayType(S.BooleanType())), S.StructField("_beta", S.ArrayType(S.DoubleType()))])
    joined = _same(df, systems.mapInPandas(solve, kept), keys)
    b = F.col("_beta")
    base = b[0] + sum((b[i + 1] * F.col(c).cast("double") for i, c in enumerate(covs)), F.lit(0.0))
    return joined.withColumn("responses", F.array(*[F.when(F.col("_seen")[a], base + b[k - 1] * a) for a in range(arms)])).drop("_beta", "_seen")


CELLS = 200_000  # distinct covariate cells of one key up to which a task fits its model; larger keys are fitted by Spark, one by one


def multinomial(x: np.ndarray, t: np.ndarray, n: np.ndarray, arms: int, penalty: float = 1.0, rounds: int = 50) -> np.ndarray | None:
    """Newton's method on the penalised likelihood of cells (x without a constant, arm, count): (arms, 1 + covariates)
    coefficients, minus infinity for the constant of an arm that no cell has. None with a single arm."""
    seen = np.unique(t)
    if len(seen) < 2:
        return None
    x = np.column_stack([np.ones(len(x)), x])
    own = (t[:, None] == seen[None, :]) * n[:, None]
    m, k = len(seen), x.shape[1]
    free = np.diag([0.0, *[1.0 / penalty] * (k - 1)])  # the constant bears no penalty
    beta = np.zeros((m, k))

    def loss(b: np.ndarray) -> float:
        z = x @ b.T
        top = z.max(1)
        return float((n * (top + np.log(np.exp(z - top[:, None]).sum(1)))).sum() - (own * z).sum() + ((b @ free) * b).sum() / 2)

    now = loss(beta)
    for _ in range(rounds):
        z = x @ beta.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = ((p * n[:, None] - own).T @ x + beta @ free).ravel()
        hess = np.block([[x.T @ (x * (n * p[:, a] * ((a == b) - p[:, b]))[:, None]) + (a == b) * free for b in range(m)] for a in range(m)])
        step = np.linalg.lstsq(hess, grad, rcond=None)[0].reshape(m, k)
        size = 1.0
        while loss(beta - size * step) > now + 1e-12 * abs(now) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now <= 1e-12 * max(1.0, abs(now)):
            break
    out = np.zeros((arms, k))
    out[:, 0] = -np.inf
    for row, a in zip(beta, seen.astype(int), strict=True):
        out[a] = row
    return out


def logistic_weights(df: DataFrame, keys: Sequence[str], covs: Sequence[str], t: str, arms: int, penalty: float = 1.0) -> DataFrame:
    """df with `weight` = 1 / P(T = t_i | x_i) from a multinomial logistic model with an L2 penalty for each key, all keys at
    once; NULL for a key with one arm, which tells nothing.

    Rows are first counted by covariate cell and arm, so a task that fits a key holds its distinct cells, at most `CELLS`;
    keys with more are fitted by Spark's own iterations over all rows. Weights are then expressions on the rows.
    """
    from functools import reduce

    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covs)]
    cells = df.groupBy(*keys, *numbers, F.col(t).cast("int").alias("_t")).agg(F.count("*").alias("_n"))
    wide = cells.groupBy(*keys).agg(F.count("*").alias("_cells")).where(F.col("_cells") > CELLS).select(*keys).collect()
    big = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in keys], F.lit(True)) for r in wide], F.lit(False))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["_t", *[f"_x{i}" for i in range(len(covs))]])
        if not len(frame):
            return pd.DataFrame(columns=[*keys, "_beta"])
        beta = multinomial(frame[[f"_x{i}" for i in range(len(covs))]].to_numpy(float), frame["_t"].to_numpy(int), frame["_n"].to_numpy(float), arms, penalty)
        return frame[list(keys)].head(1).assign(_beta=[None if beta is None else beta.tolist()])

    kept = S.StructType([*[df.schema[c] for c in keys], S.StructField("_beta", S.ArrayType(S.ArrayType(S.DoubleType())))])
    betas = cells.where(~big).groupBy(*keys).applyInPandas(fit, kept)
    rows = _same(df.where(~big), betas, keys, "left")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covs]]
    score = lambda b: sum((b[i] * v for i, v in enumerate(x)), F.lit(0.0))
    own = score(F.get(F.col("_beta"), F.col(t).cast("int")))
    weight = F.aggregate(F.transform("_beta", lambda b: F.exp(score(b) - own)), F.lit(0.0), lambda a, v: a + v)
    out = rows.withColumn("weight", weight).drop("_beta")
    for r in wide:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in keys], F.lit(True))
        out = out.unionByName(_fitted_by_spark(df.where(same), covs, t, penalty))
    return out


def _fitted_by_spark(df: DataFrame, covs: Sequence[str], t: str, penalty: float) -> DataFrame:
    """df with `weight` for one key of many distinct cells."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    seen = [r[0] for r in df.select(t).distinct().orderBy(t).collect()]
    if len(seen) < 2:
        return df.withColumn("weight", F.lit(None).cast("double"))
    place = F.array_position(F.lit(seen), F.col(t)) - 1
    data = VectorAssembler(inputCols=list(covs), outputCol="_x").transform(df.withColumn("_t", place.cast("double")))
    n = data.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_t", family="multinomial", regParam=1 / (penalty * n), standardization=False, maxIter=200, probabilityCol="_p")
    p = vector_to_array(F.col("_p"))
    out = model.fit(data).transform(data).withColumn("weight", 1 / F.get(p, F.col("_t").cast("int")))
    return out.drop("_x", "_t", "_p", "rawPrediction", "prediction")


def observed_responses(df: DataFrame, t: str, y: str, weight: str, arms: int) -> DataFrame:
    """`responses` and `weights` of the Monte-Carlo estimator: y and the weight in the row's own arm, 0 in the others."""
    own = lambda v: F.array(*[F.when(F.col(t) == a, F.col(v)).otherwise(0.0) for a in range(arms)])
    return df.withColumn("responses", own(y)).withColumn("weights", own(weight))


def bootstrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], replicates: int = 10, seed: int = 0, stratum: Sequence[str] = ()) -> DataFrame:
    """Every row as often as it is drawn, with `replicate`: n of n with replacement within keys and stratum, all at once.

    Draws come from a hash of seed, replicate and number, so that any engine and any retry draws the same.
    """
    by = [*keys, *stratum]
    rows = ranked(df, by, order, "_row")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    drawn = (
        rows.select(*by, "_row")
        .join(sizes, by)
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("_row", F.floor(draw(F.lit(seed), "replicate", *by, "_row") * F.col("_n")).cast("long"))
        .groupBy(*by, "replicate", "_row")
        .agg(F.count("*").alias("times"))
    )
    return drawn.join(rows.withColumn("_row", F.col("_row").cast("long")), [*by, "_row"]).drop("_row")


def interval(replicates: DataFrame, keys: Sequence[str], value: str = "apo", alpha: float = 0.05) -> DataFrame:
    """Keys, sd, half_width: sample deviation over replicates; one NULL replicate makes the interval NULL."""
    z = quantile(alpha)
    sd = F.when(F.count(value) == F.count("*"), F.stddev_samp(value))
    return replicates.groupBy(*keys).agg(sd.alias("sd"), (sd * z).alias("half_width"))


def validated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error that names the columns that hold NULL."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if bad := [c for c in columns if counts[c]]:
        raise ValueError(f"NULL in {', '.join(bad)}")
    return df
