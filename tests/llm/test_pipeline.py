import random

import corpus_pipeline
import pytest

from trialweave.llm import decontamination, near_duplicates, pii

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    item = " ".join(f"item{k}" for k in range(14))
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(80)]
    docs += [(200, docs[3][1]), (201, docs[3][1].upper()), (202, docs[4][1] + " tail"), (203, " ".join(word() for _ in range(40)) + " " + item + " " + " ".join(word() for _ in range(20)))]
    docs += [(204, item + " and " + item.replace("item", "other") + " " + " ".join(word() for _ in range(2))), (205, " ".join(word() for _ in range(30)) + " me@example.org"), (206, None), (207, ""), (208, "same same " * 40)]
    docs += [docs[7], docs[7], (None, " ".join(word() for _ in range(50)))]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{folder}/stage{n}")
            docs = spark.read.parquet(f"{folder}/stage{n}")
            seen[name] = {r.doc_id: r for r in docs.collect()}, docs.count()
        else:
            rows = out.collect()
    rules = seen["quality rules"]
    assert not {206, 207, 208} & set(rules[0]) and set(range(80)) <= set(rules[0]) and rules[1] == 89
    dedup = seen["near-duplicates"]
    assert not {200, 201, 202} & set(dedup[0]) and set(range(80)) <= set(dedup[0]) and dedup[1] == 84
    clean = seen["decontamination"][0]
    assert "item5" not in clean[203].text and clean[203].n_chars == len(clean[203].text)
    private = seen["personal data"][0]
    assert "me@example.org" not in private[205].text and "<EMAIL>" in private[205].text
    assert {r.doc_id for r in rows} == set(private) and all(0 < r.length <= 2048 for r in rows)


def test_run_equals_the_stages_in_turn(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == 84 and "sequence_id" in got.columns


def test_brute_force_holds_on_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    once = decontamination.decontaminate(docs, bench).select("doc_id", "text")
    assert decontamination.contamination(once, bench).where("contaminated").count() == 0
    assert near_duplicates.deduplicate(near_duplicates.deduplicate(docs)).count() == near_duplicates.deduplicate(docs).count()
    assert pii.personal_data(pii.redact(docs)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
