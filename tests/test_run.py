import json

import pytest
from test_estimators import confounded
from test_pipeline_parts import COMMENTS, POST, lines, trial

from trialweave.plans import run


def test_study_and_curate_from_the_command_line(spark, tmp_path):
    (tmp_path / "trials").mkdir()
    for n in ("N1", "N2"):
        (tmp_path / "trials" / f"{n}.json").write_text(json.dumps(trial(n)))
    run.main(["study", "--trials", f"{tmp_path}/trials", "--conditions", "diabetes", "--out", f"{tmp_path}/study"])
    assert spark.read.parquet(f"{tmp_path}/study/truth_apo").count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(lines(POST, *COMMENTS))
    reg = spark.sql("select 'Health' subreddit, 'topiramate' alias, 'N1' nct_id, timestamp '2030-01-01' cutoff")
    reg.write.parquet(f"{tmp_path}/reg")
    run.main(["curate", "--archives", f"{tmp_path}/in", "--registry", f"{tmp_path}/reg", "--out", f"{tmp_path}/reports"])
    assert {r.nct_id for r in spark.read.parquet(f"{tmp_path}/reports").collect()} == {"N1"}


@pytest.mark.parametrize("effects", [False, True])
def test_estimate_from_the_command_line(spark, tmp_path, effects):
    confounded(spark, 600, 3).write.parquet(f"{tmp_path}/rows")
    args = ["estimate", "--rows", f"{tmp_path}/rows", "--keys", "trial", "--covariates", "x", "--treatment", "t", "--outcome", "y", "--arms", "2", "--order", "id", "--replicates", "3", "--out", f"{tmp_path}/out"]
    run.main(args + ["--effects"] * effects)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == (1 if effects else 2) and all(r.ci_lower <= r.pred <= r.ci_upper for r in got)
