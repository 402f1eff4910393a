import pytest
from pyspark.sql import functions as F

from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import prompts

# Spellings that must come out as they do.
GOLDEN = [
    ("  Metformin—XR 500mg  ", "metformin-xr 500 mg"),
    ("Crème™ α-tocopherol 150µg", "creme alpha-tocopherol 150 ug"),
    ("co‍operate", "cooperate"),
    ("β-blocker", "beta-blocker"),
    ("Blinatumomab 60 µg/m²/d Step", "blinatumomab 60 ug/m 2/d step"),
    ("Libexin® 100 mg Tablets", "libexin 100 mg tablets"),
    ("B+½ OMV (Group II)", "b+1⁄2 omv (group ii)"),
    ("Part 1: Ixazomib 0.25 mg/m^2", "part 1: ixazomib 0.25 mg/m 2"),
    ("Arm I (AC-->WP)", "arm i (ac-->wp)"),
    ("  ^ ", ""),
]


@pytest.mark.parametrize("raw,want", GOLDEN)
def test_alias_spelling(raw, want):
    assert T.normalize_alias(raw) == want


def test_forum_spelling_keeps_greek_and_parts_numbers():
    assert T.normalize_forum_text("Café-10mg α B12") == "cafe 10 mg α b 12"
    assert T.normalize_forum_text(None) == "" and T.normalize_alias("α", greek=False) == "α"


def test_canonical_text_and_places():
    assert T.canonical_with_places("alpha-tocopherol 400mg/day")[0] == "alpha tocopherol 400 mg day"
    assert T.canonical_with_places("B12 and vitaminB6")[0] == "B 12 and vitaminB 6"
    text, places = T.canonical_with_places("aspirin--mg")
    assert text == "aspirin mg" and len(places) == len(text) and places[-1] == 10


def test_matcher_finds_aliases_inside_words_and_guards_the_short_one():
    m = T.Matcher(["topiramate", "sitagliptin (oral tablet)", "ldn", "abc"])
    assert m.find("mytopiramate") == ["topiramate"]
    assert m.find("on sitagliptin now") == ["sitagliptin"]
    assert m.find("took ldn today") == ["ldn"] and m.find("kaldness") == [] and m.find("ldn") == ["ldn"]
    assert m.find("abc") == [] and m.find(None) == [] and T.Matcher([]).find("x") == []


def test_rule_mask(spark):
    rows = [("This is useful text", "person", True), ("[deleted]", "person", False), ("good words here", "bot_123", True), ("https://example.org/abc", "person", False), (None, "person", False)]
    rows += [("good words here", "AutoModerator", False), ("good words", "my-bot7", False), ("[a label](https://x.y) and", None, True), ("&lt;b&gt; fine", "p", True), ("a1 b2 33 44", "p", False), ("abc 1234567890", "p", False)]
    df = spark.createDataFrame(rows, "body string, author string, want boolean")
    got = df.select(T.passes_rules(F.col("body"), F.col("author")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_content_type(spark):
    df = spark.createDataFrame([("good post", None, "a"), (None, "good comment", "a"), ("[removed]", "1", "a")], "selftext string, body string, author string")
    assert [r[0] for r in df.select(T.content_type(*map(F.col, df.columns))).collect()] == ["submissions", "comments", "unknown"]


def test_pseudonyms(spark):
    df = spark.createDataFrame([("Commenter",), (" commenter ",), ("Other",), ("[deleted]",), (None,), ("",)], "a string")
    got = [r[0] for r in df.select(T.author_key(F.col("a"))).collect()]
    assert got[0] == got[1] != got[2] and got[3:] == [None] * 3


def test_buckets_are_three_digits_and_ignore_case(spark):
    df = spark.createDataFrame([("Health",), ("health",), (None,), ("x",)], "s string")
    got = [r[0] for r in df.select(T.bucket(F.col("s"))).collect()]
    assert got[0] == got[1] and all(len(x) == 3 and 0 <= int(x) < 160 for x in got)


def test_names_and_endpoints(spark):
    df = spark.createDataFrame([("Metformin 500 mg Oral Tablet",), ("Drug-A 0.5ml (IV)",)], "n string")
    assert [r[0] for r in df.select(T.normalize_treatment(F.col("n"))).collect()] == ["metformin", "drug a"]
    ends = spark.createDataFrame([("Number of Participants with X",), ("Mean change",), ("rate  of patients",), (None,)], "t string")
    assert [r[0] for r in ends.select(T.is_binary_endpoint(F.col("t"))).collect()] == [True, False, True, False]
    assert [prompts.label(k) for k in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]


def test_anonymised(spark):
    df = spark.createDataFrame([("mail a.b@c.org, ip 10.0.0.1, +1 (456) 555-2186, 4111 1111 1111 1111, 123-45-6789",)], "t string")
    out = df.select(T.anonymized(F.col("t"))).first()[0]
    assert out == "mail <EMAIL_ADDRESS>, ip <IP_ADDRESS>, <PHONE_NUMBER>, <CREDIT_CARD>, <US_SSN>"


def test_dates(spark):
    texts = ["January 02, 2024", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456", "2024-01-02 03:04:05", "2024-01-02", "1704164645", "2024-01", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = df.select(V.forum_time(F.col("d")).alias("f"), F.year(V.trial_cutoff(F.col("d"))).alias("y"), V.literature_date(F.col("d")).alias("l")).collect()
    assert [r.f is not None for r in got] == [True] * 6 + [False] * 3
    assert got[4].y == 2024 and got[6].y == 9999 and got[8].y == 9999
    assert str(got[6].l) == "2024-01-01" and got[7].l is None


def test_outcomes(spark):
    rows = [(10.0, 50.0, None, "COUNT_OF_PARTICIPANTS", 0.2), (40.0, 0.0, "percentage", "MEAN", 0.4), (-11.3, 5.0, "points", "MEAN", -11.3), (10.0, 0.0, "%", "NUMBER", None), (5.0, 2.0, "%", None, 5.0)]
    df = spark.createDataFrame(rows, "v double, d double, u string, p string, want double")
    got = df.select(V.normalized_outcome(*map(F.col, "vdup")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_softmax_and_draws(spark):
    df = spark.range(2000).select("id", V.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(700.0) + F.col("id"))).alias("p"), V.draw(F.lit(1), "id").alias("u"))
    rows = df.collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows) and abs(sum(r.u for r in rows) / 2000 - 0.5) < 0.03
