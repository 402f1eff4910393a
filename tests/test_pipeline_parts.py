import json

import pytest
import zstandard
from pyspark.sql import functions as F

from trialweave.operators import extraction as X
from trialweave.operators import forum, relational, trials
from trialweave.plans import curate, study
from trialweave.sources import archives, external, literature, registry
from trialweave.streaming import ingest


def lines(*rows):
    return "\n".join(map(json.dumps, rows))


POST = {"id": "p1", "created_utc": "1704164645", "subreddit": "Health", "title": "My Topiramate Story!", "selftext": "I took topiramate daily", "author": "Op", "score": "3", "extra": 1}
COMMENTS = [
    {"id": "c1", "link_id": "t3_p1", "created_utc": 1704164700, "subreddit": "Health", "body": "it went well for me", "author": " op ", "score": 1},
    {"id": "c2", "link_id": "t3_p1", "created_utc": 1704164800, "subreddit": "Health", "body": "same with mytopiramate here", "author": "Other", "score": 2.5},
    {"id": "c3", "link_id": "t3_gone", "created_utc": 1704164900, "subreddit": "Health", "body": "orphaned words here", "author": "[deleted]", "score": 0},
    {"id": "c4", "link_id": "t3_p1", "created_utc": 1704164900, "subreddit": "Health", "body": "[removed]", "author": "X", "score": 0},
]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("archives")
    (path / "deep").mkdir()
    frames = zstandard.ZstdCompressor()
    (path / "deep" / "a.zst").write_bytes(frames.compress(lines(POST).encode() + b"\n") + frames.compress(lines(*COMMENTS[:2]).encode()))
    (path / "b.json").write_text(lines(*COMMENTS[2:]) + "\n{broken")
    return str(path)


def test_archives_are_read_whole_and_typed(spark, raw):
    plain = archives.read_archives(spark, raw, "*.json")
    assert {r.id for r in plain.where("id is not null").collect()} == {"c3", "c4"}
    df = spark.createDataFrame([(POST["id"], None, "1704164645", "Health", None, None, None, None, "3"), ("x", None, "no", "h", None, None, None, None, None)], archives.RAW)
    got = archives.typed(df).orderBy("id").collect()
    assert got[0].created_utc == 1704164645 and got[0].score == 3.0 and got[1].created_utc is None


def records(spark, raw):
    text = lines(POST, *COMMENTS)
    rows = [json.loads(x) for x in text.split("\n")]
    names = archives.RAW.fieldNames()
    return archives.typed(spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], archives.RAW))


def test_threads(spark, raw):
    got = {r.permalink: r for r in curate.contextualize(records(spark, raw)).collect()}
    assert len(got) == 3
    post = got["/r/Health/comments/p1/my_topiramate_story_/"]
    assert post.author_replies == ["it went well for me"] and post.report_text.endswith("\n> it went well for me")
    assert got["/r/Health/comments/p1/_/c2"].initial_post == post.report_text
    assert got["/r/Health/comments/gone/_/c3"].title is None and got["/r/Health/comments/gone/_/c3"].author_key is None


def test_curation_routes_and_gates(spark, raw):
    reg = spark.createDataFrame([("Health", "Topiramate", "N1", "2024-01-02 00:00:00"), ("Health", "topiramate", "N2", "2023-01-01 00:00:00"), ("Other", "topiramate", "N3", "2030-01-01 00:00:00")], "subreddit string, alias string, nct_id string, cutoff string")
    got = curate.curate(curate.contextualize(records(spark, raw)), reg.withColumn("cutoff", F.to_timestamp("cutoff"))).collect()
    assert {(r.nct_id, r.report_type) for r in got} == {("N1", "submission"), ("N1", "comment")}
    assert all(r.treatments_mentioned == ["topiramate"] and r.report.startswith("# All records") for r in got)


def test_partitions_and_pruned_scans(spark, raw, tmp_path):
    archives.write_partitions(archives.filtered(records(spark, raw)), str(tmp_path / "out"))
    got = archives.scan(spark, str(tmp_path / "out"), ["Health"], ["id", "bucket", "nothing"])
    assert got.columns == ["id", "bucket"] and got.count() == 4
    assert archives.scan(spark, str(tmp_path / "out"), ["None"]).count() == 0
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().toString() or "bucket" in got._jdf.queryExecution().toString()


def test_streamed_archives_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(lines(POST, COMMENTS[1]))
    where = [str(tmp_path / x) for x in ("in", "out", "offsets")]
    ingest.ingest(spark, *where)
    ingest.ingest(spark, *where)
    (tmp_path / "in" / "2.json").write_text(lines(COMMENTS[2]))
    ingest.ingest(spark, *where)
    assert sorted(r.id for r in spark.read.parquet(where[1]).collect()) == ["c2", "c3", "p1"]


def test_author_aggregation(spark):
    rows = [
        (1, "a", "January 03, 2024", "/2", "s", "second", ["Y", None]), (2, "a", "January 02, 2024", "/1", "s", "first", ["X"]), (3, "a", "January 04, 2024", "/2", "s", "again", ["Z"]),
        (4, None, "January 02, 2024", "", "s", "alone", None), (5, None, "bad date", None, "s", "alone too", []),
    ]
    got = forum.by_author(spark.createDataFrame(rows, "row_id long, author_key string, date_created string, permalink string, subreddit string, report string, treatments_mentioned array<string>")).collect()
    keyed = [r for r in got if r.author_key]
    assert len(got) == 3 and len(keyed) == 1
    assert keyed[0].source_record_count == 2 and keyed[0].treatments_mentioned == ["X", "Y"] and keyed[0].row_id == 2
    assert keyed[0].report.endswith("## Authored record 1\n\nfirst\n\n---\n\n## Authored record 2\n\nsecond")
    assert {r.report for r in got if not r.author_key} == {"## Authored record 1\n\nalone", "## Authored record 1\n\nalone too"}


def trial(nct, arms=("EXPERIMENTAL", "PLACEBO_COMPARATOR"), values=(10, 20), date="2020-01-01", **more):
    labels = [f"Drug {k}" for k in range(len(arms))]
    return {
        "protocolSection": {
            "identificationModule": {"nctId": nct, "officialTitle": f"Trial {nct}"}, "statusModule": {"completionDateStruct": {"date": date}},
            "designModule": {"designInfo": {"allocation": "RANDOMIZED", "interventionModel": more.get("model", "PARALLEL")}}, "conditionsModule": {"conditions": ["Type 2 Diabetes"]},
            "eligibilityModule": {"healthyVolunteers": more.get("healthy", False)},
            "armsInterventionsModule": {"armGroups": [{"label": n, "type": t} for n, t in zip(labels, arms)]},
            "outcomesModule": {"primaryOutcomes": [{"measure": "Number of participants with relief"}]},
        },
        "resultsSection": {
            "baselineCharacteristicsModule": {"measures": [{"title": "Age"}]},
            "outcomeMeasuresModule": {"outcomeMeasures": [{
                "type": "PRIMARY", "title": "Relief", "paramType": more.get("param", "COUNT_OF_PARTICIPANTS"), "unitOfMeasure": more.get("unit", "participants"),
                "groups": [{"id": f"G{k}", "title": n} for k, n in enumerate(labels)], "denoms": [{"counts": [{"groupId": f"G{k}", "value": "50"} for k in range(len(arms))]}],
                "classes": [{"categories": [{"measurements": []}]}, {"categories": [{"measurements": [{"groupId": f"G{k}", "value": str(v)} for k, v in enumerate(values)]}]}],
            }]},
        },
    }


def test_study_from_registry_documents(spark, tmp_path):
    docs = [trial("N1", ("EXPERIMENTAL", "ACTIVE_COMPARATOR")), trial("N2", date="2021-05-05"), trial("N3", healthy=True), trial("N4", model="CROSSOVER"), trial("N5", ("EXPERIMENTAL",), ("1,000",), unit="Percentage", param="MEAN", date="2019-01-01")]
    for d in docs:
        (tmp_path / f"{d['protocolSection']['identificationModule']['nctId']}.json").write_text(json.dumps(d, indent=1))
    got = study.build(registry.read_trials(spark, str(tmp_path)), ["diabetes"], 0.5)
    assert got.funnel.first().asDict() == {"randomized": 5, "parallel": 4, "arms": 4, "ill": 3, "binary": 3, "trials": 5}
    apo = {(r.nct_id, r.arm): r.apo for r in got.truth_apo.collect()}
    assert apo[("N1", "Drug 0")] == pytest.approx(0.2) and apo[("N1", "Drug 1")] == pytest.approx(0.4) and apo[("N5", "Drug 0")] == pytest.approx(10)
    assert ("N2", "Drug 1") not in apo
    assert got.truth_ate.count() == 0 or {r.nct_id for r in got.truth_ate.collect()} == {"N1"}
    assert {r.nct_id: r.split for r in got.trials.collect()} == {"N5": "train", "N1": "val", "N2": "val"}
    assert {r.title for r in got.covariates.collect()} == {"Age", "Country", "Duration"}
    assert study.build(registry.read_trials(spark, str(tmp_path)), ["asthma"]).trials.count() == 0


def test_condition_match_both_ways(spark):
    df = spark.createDataFrame([(["Breast Cancer"],), (["Cancer"],), (["Flu"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(trials.matches_condition(F.col("t"), F.lit(["breast_cancer"]))).collect()] == [True, True, False, False]


class Fake:
    asked: list = []

    def answer(self, prompts):
        return [None if "fail" in p else {"vote": "YES" if "good" in p else "no", "x": 1.5} for p in prompts]


def test_extraction_validates_and_resumes(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fail"), (4, "good")], "id long, text string")
    cached = spark.createDataFrame([(4, "No", 0.0), (9, "No", 0.0)], "id long, vote_k string, x_k double")
    got = X.extract(df, "id", F.col("text"), Fake(), {"vote": ["Yes", "No"], "x": float}, "_k", cached).collect()
    assert sorted(tuple(r) for r in got) == [(1, "Yes", 1.5), (2, "No", 1.5), (4, "No", 0.0)]
    assert X.validated_answer({"a": "nan"}, {"a": float}) is None and X.validated_answer({"a": 1, "b": 2}, {"a": float}) is None


def test_votes(spark):
    votes = spark.createDataFrame([(1, v) for v in ["Yes"] * 5 + ["yes"] + ["No"] * 2] + [(2, None)], "id long, vote string")
    got = X.vote_fractions(votes, "id", "vote").collect()
    assert len(got) == 1 and got[0].inclusion_probs == [0.25, 0.75] and got[0].n_votes == 8
    assert X.vote_requests(spark.range(2), 25).count() == 50


def test_outcome_filters(spark):
    verdict = lambda rows, **k: [r[0] for r in spark.createDataFrame(rows, "o string, b string").select(X.outcome_verdict(F.col("o"), F.col("b"), **k)).collect()]
    assert verdict([("2.0", None), (None, None), ("inf", None), ("4.0", None), ("nan", None)]) == ["keep", "not_numeric", "not_numeric", "keep", "not_numeric"]
    assert verdict([(x, None) for x in ("12", "4444000", "-3", "55")], bounds=(0, 55)) == ["keep", "out_of_bounds", "out_of_bounds", "keep"]
    assert verdict([("1", "w"), ("1", None), ("1", "v")], wanted_basis="w") == ["keep", "other_basis", "other_basis"]
    with pytest.raises(ValueError, match="missing"):
        X.treatment_outcome_known(spark.range(1), ["A"])


def test_conditionals_and_ownership(spark):
    combos = relational.combinations({"t": ["A", "B"], "y": ["No", "Yes"]}, spark)
    assert [(r.t, r.y) for r in combos.orderBy("combo").collect()] == [("A", "No"), ("A", "Yes"), ("B", "No"), ("B", "Yes")]
    scores = combos.select(F.lit(1).alias("id"), "combo", F.lit(0.5).alias("score")).union(combos.where("combo < 3").select(F.lit(2), "combo", F.lit(0.5)))
    assert [(r.id, r.probs) for r in X.conditional_probabilities(scores, "id").collect()] == [(1, [0.25] * 4)]
    rec = spark.createDataFrame([(1, "submission"), (2, "comment"), (3, "comment")], "id long, report_type string")
    said = spark.createDataFrame([(2, "Yes"), (9, "Yes")], "id long, ownership string")
    assert sorted(r.id for r in X.owned(rec, said, "id").collect()) == [1, 2] and X.owned(rec, said, "id", "literature").count() == 3


def test_chained_stops_on_empty(spark):
    out, log = X.chained(spark.range(3), [("a", lambda d: d.where("id > 5")), ("b", lambda d: 1 / 0)])
    assert [x["stage"] for x in log] == ["a"] and out.count() == 0
    with pytest.raises(RuntimeError, match="b"):
        X.chained(spark.range(3), [("b", lambda d: 1 / 0)])


ARTICLE = """<Set><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>A case</ArticleTitle><Abstract><AbstractText>Some ""text""</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><LastName>Roe</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Case Reports</PublicationType></PublicationTypeList><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pmc">pmc7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>Other</ArticleTitle></Article></MedlineCitation></PubmedArticle></Set>"""
DRUGS = """<drugbank><drug><name> Aspirin </name><synonyms><synonym>ASA</synonym></synonyms><products><product><name>Bayer X</name></product></products></drug><drug><name>Ibuprofen</name></drug></drugbank>"""


def test_articles_and_drugs(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE)
    (tmp_path / "d.xml").write_text(DRUGS)
    got = literature.read_articles(spark, str(tmp_path / "a.xml"))
    rows = {r.pmid: r for r in literature.cleaned(got).collect()}
    assert set(rows) == {"1"} and rows["1"].report == 'A case\n\nSome "text"' and rows["1"].pmc_id == "PMC7" and rows["1"].authors == "J Doe, Roe"
    assert [r[0] for r in got.orderBy("pmid").select(literature.is_case_report(F.col("types"))).collect()] == [True, False]
    drugs = literature.read_drugs(spark, str(tmp_path / "d.xml"))
    names = spark.createDataFrame([("asa",), ("nothing",)], "name string")
    assert {r.alias for r in literature.aliases_of(drugs, names).collect()} == {"aspirin", "asa", "bayer x"}
    assert literature.full_text_of("<a><article-title>T</article-title><body><sec><title>S</title><p>one <i>two</i></p></sec></body></a>") == "T\n\n## S\n\none two"
    assert literature.full_text_of("<broken") is None
    assert literature.prompt_text("{{ a }} and {{ b }}", {"a": "x"}) == "x and {{ b }}"


def test_limits_and_retries():
    now = [0.0]
    bucket = external.TokenBucket(60, 60, lambda: now[0])
    assert bucket.take(60) and not bucket.take(1) and bucket.wait_for(30) == 30 and bucket.wait_for(61) == float("inf")
    now[0] = 30
    assert bucket.take(30) and not bucket.take(1)
    both = external.RateLimiter(a=external.TokenBucket(1, 60, lambda: 0), b=external.TokenBucket(0.5, 60, lambda: 0))
    assert not both.take(a=1, b=1) and both.take(a=1)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert external.with_retries(flaky, sleep=lambda s: None) == "ok" and len(tries) == 3
    with pytest.raises(ValueError):
        external.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)


def test_pages_are_read_by_task(spark):
    class Pages(external.PagedSource):
        @classmethod
        def name(cls):
            return "testpages"

        fetch = staticmethod(lambda page: iter([(page, f"body {page}")]))

    spark.dataSource.register(Pages)
    assert spark.read.format("testpages").option("pages", 3).load().count() == 3


def test_upsert_and_first(spark):
    old = spark.createDataFrame([(1, "old")], "pmid long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "pmid long, v string")
    assert sorted(tuple(r) for r in relational.upsert(old, new, ["pmid"], ["v"]).collect()) == [(1, "old"), (2, "a")]


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_temporal_split_equals_sorting(spark, ratio):
    rows = [(f"N{k:02d}", None if k % 7 == 0 else f"2020-01-0{k % 4 + 1}") for k in range(23)]
    got = {r.nct_id: r.split for r in trials.temporal_split(spark.createDataFrame(rows, "nct_id string, date string"), "date", "nct_id", ratio).collect()}
    first = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))][: int(23 * ratio)]
    assert {i for i, s in got.items() if s == "train"} == set(first) and len(got) == 23
