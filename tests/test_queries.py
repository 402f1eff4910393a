"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from trialweave import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame: pd.DataFrame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, bool):
            return str(v)
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)[:19] if hasattr(v, "isoformat") else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.REGISTERED))
def test_query_equals_sql(spark, duck, name):
    got = queries.REGISTERED[name](spark, DATA).toPandas()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_mc_ipw_fits_every_trial(spark):
    """Newton's method on the penalised likelihood of each trial."""
    got = {(r.trial, r.arm): r.apo for r in queries.REGISTERED["mc_ipw_apo"](spark, DATA).collect()}
    want = {}
    for trial, df in queries.reports(spark, DATA).select("trial", "large", "q", "t", "y").toPandas().groupby("trial"):
        x = np.column_stack([np.ones(len(df)), df[["large", "q"]].astype(float)])
        own = np.eye(3)[df["t"].astype(int)]
        beta, free = np.zeros((3, 3)), np.diag([0.0, 1.0, 1.0])  # the intercept bears no penalty
        for _ in range(30):
            p = np.exp(x @ beta)
            p /= p.sum(1, keepdims=True)
            grad = (x.T @ (p - own) + free @ beta).T.ravel()
            hess = np.block([[x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]) + (a == b) * free for b in range(3)] for a in range(3)])
            beta -= np.linalg.lstsq(hess, grad, rcond=None)[0].reshape(3, 3).T
        w, y = (own / p), df["y"].to_numpy(float)
        want |= {(trial, a): (w[:, a] @ y) / w[:, a].sum() for a in range(3)}
    assert len(want) == 9 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=0.0015) for k in want)
