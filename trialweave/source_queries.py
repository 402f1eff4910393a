"""Queries of sources, prompts, extraction stages and bookkeeping over the driver's tables, with the SQL that each equals.

Where an operator reads files or asks a service, the query first makes these from the tables: files in the folder that
driver and executors share, answers by a rule that the SQL repeats.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import bookkeeping as B
from trialweave.operators import discretize as D
from trialweave.operators import extraction as X
from trialweave.operators import forum, prompts, relational, results, trials
from trialweave.plans import estimate, study
from trialweave.queries import query, r6, read
from trialweave.sources import archives, literature, registry, services
from trialweave.sources.external import is_retryable


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, and one of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- trials -----------------------------------------------------------------------------------------------------------

_ARM = "CASE p_type WHEN 'ECONOMY' THEN 'EXPERIMENTAL' WHEN 'SMALL' THEN 'PLACEBO_COMPARATOR' ELSE 'OTHER' END"


def _kind():
    return F.when(F.col("p_type") == "ECONOMY", "EXPERIMENTAL").when(F.col("p_type") == "SMALL", "PLACEBO_COMPARATOR").otherwise("OTHER")


@query("SELECT p_partkey FROM part WHERE p_type <> 'SMALL'")
def non_control_arms(spark, sf_dir):
    return read(spark, sf_dir, "part").where(trials.is_not_control(_kind())).select("p_partkey")


def _trials(spark, sf_dir) -> DataFrame:
    """Registry documents: a trial for each part, whose supplier-like groups are two cohorts of a primary outcome."""
    part = read(spark, sf_dir, "part")
    name, size, price = F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    arms = F.array(
        F.struct(F.lit("Drug").alias("label"), F.lit("EXPERIMENTAL").alias("type"), name.alias("description")),
        F.struct(F.lit("Sham").alias("label"), F.when(size % 2 == 0, "ACTIVE_COMPARATOR").otherwise("SHAM_COMPARATOR").alias("type"), name.alias("description")),
    )
    null = F.lit(None).cast("string")
    measurement = lambda g, v: F.struct(F.lit(g).alias("groupId"), v.cast("string").alias("value"), F.lit("1.5").alias("spread"), F.lit("0.1").alias("lowerLimit"), F.lit("0.9").alias("upperLimit"))
    outcome = F.struct(
        F.when(size % 5 == 0, "SECONDARY").otherwise("PRIMARY").alias("type"), F.concat(F.lit("Number of participants "), name).alias("title"),
        null.alias("timeFrame"), null.alias("description"), F.when(size % 3 == 0, "NUMBER").otherwise("MEAN").alias("paramType"),
        F.when(size % 2 == 0, "95% Confidence Interval").otherwise("Standard Deviation").alias("dispersionType"),
        F.when(size % 7 == 0, "percentage of x").otherwise("points").alias("unitOfMeasure"),
        F.array(*[F.struct(F.lit(g).alias("id"), F.lit(t).alias("title"), null.alias("description")) for g, t in (("G0", "Drug"), ("G1", "Sham"), ("G2", "Drug"))]).alias("groups"),
        F.array(F.struct(F.array(*[F.struct(F.lit(g).alias("groupId"), (size + 10).cast("string").alias("value")) for g in ("G0", "G1", "G2")]).alias("counts"))).alias("denoms"),
        F.array(
            F.struct(F.array(F.struct(F.array(measurement("G9", price)).alias("measurements"))).alias("categories")),
            F.struct(F.array(F.struct(F.array(measurement("G0", size), measurement("G1", size * 2), measurement("G2", size * 9)).alias("measurements"))).alias("categories")),
        ).alias("classes"),
    )
    ident = F.concat(F.lit("NCT"), F.col("p_partkey").cast("string"))
    return part.select(
        F.struct(
            F.struct(ident.alias("nctId"), name.alias("officialTitle"), name.alias("briefTitle")).alias("identificationModule"),
            F.struct(arms.alias("armGroups")).alias("armsInterventionsModule"),
        ).alias("protocolSection"),
        F.struct(F.struct(F.array(outcome).alias("outcomeMeasures")).alias("outcomeMeasuresModule")).alias("resultsSection"),
    )


_TRUTH = """WITH p AS (SELECT 'NCT' || p_partkey AS nct_id, p_size AS s FROM part WHERE p_size % 5 <> 0),
a AS (SELECT nct_id, s, 'Drug' AS arm, s::DOUBLE AS v FROM p UNION ALL SELECT nct_id, s, 'Sham', 2.0 * s FROM p WHERE s % 2 = 0)
SELECT nct_id, arm, round(CASE WHEN s % 7 = 0 THEN v / 100 WHEN s % 3 = 0 THEN v / (s + 10) ELSE v END, 6) AS apo,
       CASE WHEN s % 2 = 0 THEN 0.1 ELSE 1.5 END AS lower, CASE WHEN s % 2 = 0 THEN 0.9 END AS upper, s % 3 = 0 AS is_binary FROM a"""


@query(_TRUTH)
def trial_truth(spark, sf_dir):
    """Documents as JSON files, read by the registry's schema, to ground truth."""
    path = shared(spark, "trials")
    _trials(spark, sf_dir).write.json(path)
    got = trials.truth(registry.read_trials(spark, path, lines=True))
    return got.select("nct_id", "arm", r6(F.col("apo")).alias("apo"), F.col("bounds.lower").alias("lower"), F.col("bounds.upper").alias("upper"), F.col("binary").alias("is_binary"))


@query("SELECT p_partkey, p_type = 'ECONOMY' OR regexp_matches(p_name, '(?i)ring') AS is_binary FROM part")
def binary_outcome(spark, sf_dir):
    param = F.when(F.col("p_type") == "ECONOMY", "COUNT_OF_PARTICIPANTS")
    title = F.when(F.lower("p_name").contains("ring"), "Percentage of patients well").otherwise("Time to event")
    return read(spark, sf_dir, "part").select("p_partkey", V.is_binary_outcome(param, title).alias("is_binary"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size - 1.0 ELSE p_retailprice END AS lower, CASE WHEN p_size % 2 = 0 THEN p_size + 1.0 END AS upper FROM part""")
def dispersion_pick(spark, sf_dir):
    size = F.col("p_size").cast("double")
    kind = F.when(F.col("p_size") % 2 == 0, "90% Confidence Interval").otherwise("Standard Error")
    return read(spark, sf_dir, "part").select("p_partkey", V.dispersion(kind, F.col("p_retailprice"), size - 1, size + 1).alias("b")).select("p_partkey", "b.lower", "b.upper")


@query("""SELECT o_custkey AS trial, o_orderpriority AS arm FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <= 12""")
def size_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trial"), F.col("o_orderpriority").alias("arm"))
    return estimate.sized(rows, ["trial"], 12)


@query("SELECT split, count(DISTINCT nct_id) AS trials FROM (SELECT CASE WHEN p_size <= 25 THEN 'train' ELSE 'val' END AS split, p_brand AS nct_id FROM part UNION ALL SELECT 'test', p_name FROM part) GROUP BY split")
def unique_trials(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    one = part.select(F.when(F.col("p_size") <= 25, "train").otherwise("val").alias("split"), F.col("p_brand").alias("nct_id"))
    two = part.select(F.lit("test").alias("split"), F.col("p_name").alias("nct_id"))
    return study.unique_trials([study.Study(x, None, None, None, None) for x in (one, two)])


@query("SELECT p_partkey, p_name FROM part")
def study_tables(spark, sf_dir):
    """A study written as tables and read again."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    path = shared(spark, "study")
    study.save(study.Study(*[rows] * 5), path)
    return study.load(spark, path).covariates


@query("SELECT o_custkey AS trial, round(o_totalprice - 100, 2) AS low_error, round(o_totalprice * 0, 2) + 5.0 AS high_error, round(o_shippriority_like / 100.0, 6) AS dispersion FROM (SELECT *, o_orderkey % 40 AS o_shippriority_like FROM orders)")
def forest_series(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trial"), F.col("o_totalprice").alias("pred"), F.lit(100.0).alias("ci_lower"), (F.col("o_totalprice") + 5).alias("ci_upper"),
        (F.col("o_orderkey") % 40).alias("dispersion"), F.col("o_orderkey").alias("truth"),
    )
    got = results.forest_series(o, percent=True)
    return got.select("trial", F.round("low_error", 2).alias("low_error"), F.round("high_error", 2).alias("high_error"), F.round("dispersion", 6).alias("dispersion"))


# --- values and names -------------------------------------------------------------------------------------------------

_LABEL = "CASE WHEN {0} >= 0 THEN chr((97 + {0} % 26)::INT) ELSE '' END"


@query(f"""SELECT k, {_LABEL.format('k2')} || {_LABEL.format('k1')} || {_LABEL.format('k')} AS label FROM
(SELECT k, k // 26 - 1 AS k1, CASE WHEN k // 26 - 1 >= 0 THEN (k // 26 - 1) // 26 - 1 ELSE -1 END AS k2 FROM (SELECT DISTINCT p_partkey % 5000 AS k FROM part))""")
def alphabet_labels(spark, sf_dir):
    k = read(spark, sf_dir, "part").select((F.col("p_partkey") % 5000).alias("k")).distinct()
    return k.select("k", T.alphabet_label(F.col("k")).alias("label"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') || '-01' WHEN 2 THEN strftime(ts, '%Y') || '-01-01' END AS day FROM events""")
def literature_dates(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM")).when(k == 2, F.date_format("ts", "yyyy")).otherwise("soon")
    return read(spark, sf_dir, "events").select("event_id", V.literature_date(text).cast("string").alias("day"))


@query(r"SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || '/' || p_size || ').csv', '[^\w\-.]', '_', 'g') AS name FROM part")
def file_names(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(").csv"))
    return read(spark, sf_dir, "part").select("p_partkey", T.file_name(name).alias("name"))


@query("SELECT event_id, (event_id % 97)::BIGINT AS data_count FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def data_counts(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("{'data_count': "), (F.col("event_id") % 97).cast("string"), F.lit(", 'cost': 0.5}")))
    return read(spark, sf_dir, "events").select("event_id", B.data_count(text).alias("data_count"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '|x y|' || user_id END AS items FROM events")
def literal_lists(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("['"), "event_type", F.lit("', 'x y', '"), F.col("user_id").cast("string"), F.lit("']")))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(B.literal_list(text), "|").alias("items"))


@query("SELECT doc_id, (ceil(length(text) / 4.0) + 300)::BIGINT AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", prompts.token_estimate(F.col("text"), 100, 3).alias("tokens"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'knowns' WHEN 1 THEN 'sample_ty' WHEN 2 THEN 'ty_given_x' END AS stage, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END AS place FROM part""")
def stage_files(spark, sf_dir):
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "knowns").when(k == 1, "sample_ty").when(k == 2, "ty_given_x").otherwise("other")
    df = read(spark, sf_dir, "part").select("p_partkey", B.stage_of(F.concat(F.lit("nct_"), kind, F.lit("_v1.csv"))).alias("stage"))
    return df.withColumn("place", B.stage_rank(F.col("stage")))


@query("SELECT doc_id, (status IN (429, 500, 502, 503, 504)) AS again FROM (SELECT doc_id, [200, 404, 429, 500, 502, 503, 504][doc_id % 7 + 1] AS status FROM documents)")
def retryable_answers(spark, sf_dir):
    class Answer(Exception):
        def __init__(self, status):
            self.status = status

    statuses = (200, 404, 429, 500, 502, 503, 504)
    again = F.lit([is_retryable(Answer(s)) for s in statuses])
    return read(spark, sf_dir, "documents").select("doc_id", F.get(again, (F.col("doc_id") % 7).cast("int")).alias("again"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, CASE l_linestatus WHEN 'F' THEN 0.0 ELSE 1.0 END AS y FROM lineitem")
def outcome_codes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linestatus") == "F", "NO").otherwise("Yes").alias("o"))
    coded = D.treatment_codes(rows, "l_returnflag", ["R", "N", "A"])
    return coded.select("l_orderkey", "l_linenumber", F.col("l_returnflag_discretized").alias("t"), D.outcome_code(F.col("o"), True).alias("y"))


@query("""WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) SELECT o_orderkey, (o_totalprice > m)::INT AS price, CASE o_orderstatus WHEN 'Z' THEN -1 ELSE k END AS status
FROM orders, m JOIN (SELECT o_orderstatus AS s, (row_number() OVER (ORDER BY n DESC, f) - 1) AS r, n, sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, f ROWS UNBOUNDED PRECEDING) AS tail FROM (SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1)) c ON true
JOIN LATERAL (SELECT 1) ON true, LATERAL (SELECT c.r::INT AS k) WHERE c.s = o_orderstatus""")
def discretize_all(spark, sf_dir):
    """Numbers by their median, categories by their counts: the dispatcher."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    coded, _ = D.discretize(orders, "o_totalprice", "o_orderkey")
    coded, _ = D.discretize(coded, "o_orderstatus", "o_orderkey")
    return coded.select("o_orderkey", F.col("o_totalprice_discretized").alias("price"), F.col("o_orderstatus_discretized").cast("int").alias("status"))


# --- sets, sorts and counts -------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(spark, sf_dir):
    return relational.common(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def remaining_keys(spark, sf_dir):
    return relational.remaining(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT DISTINCT p_brand AS condition FROM part WHERE p_brand IS NOT NULL")
def condition_list(spark, sf_dir):
    return relational.sorted_distinct(read(spark, sf_dir, "part").select(F.col("p_brand").alias("condition")), "condition")


@query("SELECT o_orderpriority AS subreddit, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def latest_cutoffs(spark, sf_dir):
    return forum.latest_cutoffs(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("subreddit"), F.col("o_orderdate").alias("cutoff")), name="latest")


@query("SELECT c_custkey AS name, 'c' || c_nationkey AS alias FROM customer UNION SELECT s_suppkey, 's' || s_nationkey FROM supplier UNION SELECT c_custkey, 'c' || c_nationkey FROM customer")
def alias_sets(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("alias"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("alias"))
    return literature.alias_union(c, s, c)


@query("""WITH d AS (SELECT lower(trim(p_brand)) AS drug, lower(trim(p_name)) AS alias FROM part UNION SELECT lower(p_brand), lower(p_brand) FROM part),
o AS (SELECT alias, max(drug) AS drug FROM d GROUP BY alias)
SELECT DISTINCT n.p_name AS name, d.alias FROM (SELECT DISTINCT p_name FROM part) n JOIN o ON lower(trim(n.p_name)) = o.alias JOIN d USING (drug)""")
def drug_aliases(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    drugs = part.select(F.lower(F.trim("p_brand")).alias("drug"), F.lower(F.trim("p_name")).alias("alias")).union(part.select(F.lower("p_brand"), F.lower("p_brand"))).distinct()
    return literature.aliases_of(drugs, part.select(F.col("p_name").alias("name")).distinct())


# --- prompts and extraction -------------------------------------------------------------------------------------------

_OPTIONS = {"treatment": ["Drug A", "Drug B"], "outcome": ["No", "Yes"]}
_QUESTIONS = {"treatment": "Which treatment was taken?", "outcome": "Did it help?"}
_NL = "chr(10)"


@query(f"""SELECT (2 * a.k + b.k)::BIGINT AS combo, a.v AS treatment, b.v AS outcome,
{_NL} || {_NL} || '**Multiple Choice Question(s):**' || {_NL} || {_NL} || 'Q: Which treatment was taken?' || {_NL} || 'Options: a) Drug A b) Drug B ' || {_NL} || 'A: ' || a.v
|| {_NL} || {_NL} || 'Q: Did it help?' || {_NL} || 'Options: a) No b) Yes ' || {_NL} || 'A: ' || b.v AS suffix
FROM (VALUES (0, 'Drug A'), (1, 'Drug B')) a(k, v), (VALUES (0, 'No'), (1, 'Yes')) b(k, v)""")
def choice_prompts(spark, sf_dir):
    return prompts.choice_prompts(spark, _QUESTIONS, _OPTIONS)


@query(f"""SELECT conv_id, turn, 'Outcome: pain' || {_NL} || 'Known:' || {_NL} || CASE WHEN turn % 2 = 0 THEN 'role: ' || role ELSE '' END || {_NL} || coalesce(text, '') || ' {{{{ other }}}}' AS prompt FROM conversations""")
def report_prompts(spark, sf_dir):
    known = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("Unknown")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", known.alias("role"))
    template = "Outcome: {{ outcome }}\nKnown:\n{{known}}\n{{ report }} {{ other }}"
    return rows.select("conv_id", "turn", prompts.rendered(template, {"outcome": F.lit("pain"), "known": prompts.known_answers(["role"]), "report": F.col("text")}).alias("prompt"))


@query("""WITH s AS (SELECT p_partkey, c, -(length(p_name) % 7) - c * (p_partkey % 3) AS v FROM part, (VALUES (0), (1), (2), (3)) t(c))
SELECT p_partkey, c::INT AS combo, round(exp(v) / sum(exp(v)) OVER (PARTITION BY p_partkey), 6) AS p FROM s""")
def scored_conditionals(spark, sf_dir):
    """Requests for all answers, scored by a rule in place of a model, to probabilities."""
    part = read(spark, sf_dir, "part")
    asked = prompts.scoring_requests(part, F.col("p_name"), prompts.choice_prompts(spark, _QUESTIONS, _OPTIONS), "p_partkey")
    length = F.instr("text", "\n") - 1
    scored = asked.withColumn("score", (-(length % 7) - F.col("combo") * (F.col("p_partkey") % 3)).cast("double"))
    got = X.conditional_probabilities(scored, "p_partkey")
    return got.select("p_partkey", F.posexplode("probs").alias("combo", "p")).withColumn("p", r6(F.col("p")))


def answered(prompts_: list[str]) -> list[str | None]:
    """A model by rule: what it says follows from the kind of question and the length of the report."""
    out = []
    for p in prompts_:
        kind, _, rest = p.partition("\n")
        vote, report = (rest.split("\n", 2) + ["", ""])[1:3]
        n = len(report)
        said = {
            "relevance": {"is_relevant": "YES" if n % 3 else "no"},
            "ty_filter": {"treatment_taken": "drug a" if n % 2 else "Unknown", "outcome_category": "yes"},
            "knowns": {"sex": "Female" if n % 5 else "Unknown"},
            "imputations": {"sex": "Male" if n % 7 else "Female"},
            "sample_ty": {"treatment_taken": "Drug A", "outcome_category": "No" if n % 4 else "Yes"},
            "inclusion": {"meets_inclusion_criteria": "Yes" if vote.isdigit() and (n + int(vote)) % 4 else "No"},
        }.get(kind, {})
        out.append(None if n % 11 == 0 else f"```json\n{json.dumps(said)}\n```")
    return out


@query("""SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN 'Female' ELSE 'Unknown' END AS sex, CASE WHEN length(text) % 7 <> 0 THEN 'Male' ELSE 'Female' END AS sex_imputed,
CASE WHEN length(text) % 4 <> 0 THEN 'No' ELSE 'Yes' END AS outcome, round((SELECT avg(((length(text) + v) % 4 <> 0)::INT) FROM range(8) t(v)), 6) AS p_in
FROM documents WHERE length(text) % 3 <> 0 AND length(text) % 2 <> 0 AND length(text) % 11 <> 0""")
def extraction_stages(spark, sf_dir):
    """All stages in order, with answers in text from a rule."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("report"))
    stages = X.Stages(X.JsonExtractor(answered), "doc_id", "pain", ["Drug A"], {"sex": ["Female", "Male"]}, votes=8)
    got = docs
    for _, run in stages.all():
        got = run(got)
    return got.select("doc_id", "sex", "sex_imputed", F.col("outcome_category_sampled").alias("outcome"), r6(F.col("inclusion_probs")[1]).alias("p_in"))


def named(prompts_: list[str]) -> list[str | None]:
    """Names by rule: the words of the prompt's first line but its last, none where it is long."""
    out = []
    for p in prompts_:
        words = re.findall(r"[a-z]+", p.lower().split("?")[0])
        out.append(json.dumps({"names": words[-2:]}) if len(p) % 13 else None)
    return out


@query("""SELECT p_name AS condition, CASE WHEN p_name = (SELECT min(p_name) FROM part) THEN 'known' WHEN length('Which forums discuss ' || p_name || '?' || chr(10) || 'posts') % 13 = 0 THEN ''
ELSE array_to_string(list_slice(regexp_extract_all(lower('which forums discuss ' || p_name), '[a-z]+'), -2, -1), ',') END AS forums
FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 5 UNION SELECT min(p_name) FROM part)""")
def condition_forums(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_name").alias("condition"), "p_size")
    found = part.where("p_size > 5").select("condition").distinct().withColumn("posts", F.lit("posts"))
    known = part.agg(F.min("condition").alias("condition")).withColumn("names", F.array(F.lit("known")))
    got = X.condition_forums(part, found, X.JsonExtractor(named), known)
    return got.select("condition", F.array_join("names", ",").alias("forums"))


# --- services ---------------------------------------------------------------------------------------------------------


def _page(sizes: dict[str, int], path: str, asked: dict[str, str]) -> tuple[int, str]:
    """A registry by rule: pages of parts by their numbers, the last one not there."""
    first = int(asked.get("pageToken", "0"))
    if first >= sizes["stop"]:
        return 503 if asked.get("never") else 404, "gone"
    studies = [{"id": k} for k in range(first, min(first + 50, sizes["stop"]))]
    return 200, json.dumps({"studies": studies, "totalCount": sizes["n"], "nextPageToken": str(first + 50)})


@query("SELECT k::BIGINT AS id FROM range(130) t(k)")
def registry_pages(spark, sf_dir):
    """Pages by token until one is missing, saved as lines and read again."""
    path = shared(spark, "registry")
    services.save_trials(spark, services.registry_pages(partial(_page, {"n": 200, "stop": 130})), path)
    return spark.read.schema("id long").json(path)


@query("""SELECT p_partkey, CASE WHEN length(q) > 1800 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN p_size % 3 <> 0 THEN 'E' || p_partkey END AS web_env
FROM (SELECT p_partkey, p_size, repeat(p_name || ' ', p_size * 3) AS q FROM part)""")
def search_requests(spark, sf_dir):
    sent = services.search_request(F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_size") * 3).cast("int")))
    xml = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("<r><WebEnv>E"), F.col("p_partkey").cast("string"), F.lit("</WebEnv><QueryKey>1</QueryKey></r>"))).otherwise("<r><ERROR>none</ERROR></r>")
    return read(spark, sf_dir, "part").select("p_partkey", sent["method"].alias("method"), services.search_answer(xml)["web_env"].alias("web_env"))


@query("SELECT p_brand AS source, string_agg(DISTINCT lower(replace(p_name, ' ', '')), ',' ORDER BY lower(replace(p_name, ' ', ''))) AS names FROM part GROUP BY p_brand")
def archive_index(spark, sf_dir):
    name = F.lower(F.replace("p_name", F.lit(" "), F.lit("")))
    line = F.concat(F.lit('<a href="/files/'), name, F.lit('_comments.zst">x</a>'))
    page = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.collect_list(line), "\n").alias("html"))
    return page.select("source", F.array_join(F.array_sort(services.indexed_names(F.col("html"))), ",").alias("names"))


@query("SELECT p_name AS subreddit FROM part WHERE p_size % 4 <> 0 GROUP BY p_name")
def forum_descriptions(spark, sf_dir):
    got = read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 == 0, "error").otherwise(F.col("p_name")).alias("subreddit"))
    return services.about(got)


@query("""SELECT source, place, '**Title**: ' || doc_id || chr(10) || '**Post content**: ' || left(coalesce(text, ''), 1000) AS snippet
FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS place FROM documents) WHERE place <= 5""")
def top_posts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("title", F.col("doc_id").cast("string"))
    return services.top_posts(docs, "source", [F.desc("n_chars"), F.col("doc_id")], "title", "text")


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS json FROM conversations GROUP BY conv_id""")
def posts_as_json(spark, sf_dir):
    return services.as_json(read(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "role")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0")
def case_reports(spark, sf_dir):
    k = F.col("page_id") % 3
    types = F.when(k == 0, F.array(F.lit("Journal Article"), F.lit("CASE Reports"))).when(k == 1, F.array(F.lit("Review")))
    return read(spark, sf_dir, "pages").where(literature.is_case_report(types)).select("page_id")


@query("""SELECT p_partkey::VARCHAR AS pmid, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'About ' || p_brand ELSE 'No abstract available' END AS abstract,
p_brand || ' One, Two' AS authors, '2020-0' || (p_size % 9 + 1) || '-' AS date, CASE WHEN p_size % 3 = 0 THEN 'PMC' || p_partkey END AS pmc_id FROM part WHERE p_size % 10 <> 0""")
def article_metadata(spark, sf_dir):
    """Articles as XML files, read by their rows."""
    text = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    size, ident = F.col("p_size"), F.col("p_partkey").cast("string")
    abstract = F.when(size % 2 == 0, text("Abstract", text("AbstractText", F.concat(F.lit("About "), "p_brand")))).otherwise("")
    author = F.concat(F.lit("<AuthorList><Author>"), text("LastName", F.lit("One")), text("ForeName", F.col("p_brand")), F.lit("</Author><Author><LastName>Two</LastName></Author></AuthorList>"))
    date = F.concat(F.lit("<Journal><JournalIssue><PubDate><Year>2020</Year>"), text("Month", F.concat(F.lit("0"), (size % 9 + 1).cast("string"))), F.lit("</PubDate></JournalIssue></Journal>"))
    title = F.when(size % 10 != 0, text("ArticleTitle", F.col("p_name"))).otherwise("")
    pmc = F.when(size % 3 == 0, F.concat(F.lit('<ArticleId IdType="pmc">PMC'), ident, F.lit("</ArticleId>"))).otherwise("")
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), text("PMID", ident), F.lit("<Article>"), title, abstract, author, date, F.lit("</Article></MedlineCitation><PubmedData><ArticleIdList>"), pmc, F.lit('<ArticleId IdType="doi">1</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'))
    path = shared(spark, "articles")
    edges = spark.createDataFrame([(0, "<PubmedArticleSet>"), (2, "</PubmedArticleSet>")], "o int, value string")
    rows = read(spark, sf_dir, "part").select(F.lit(1).alias("o"), xml.alias("value")).union(edges)
    rows.repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return literature.read_articles(spark, path).drop("types")


@query("""SELECT page_id, 'T' || page_id || chr(10) || chr(10) || '## Intro' || chr(10) || chr(10) || 'first ' || page_id || ' words' || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || 'deep' ELSE '' END AS body
FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 = 0""")
def article_texts(spark, sf_dir):
    k = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 2 == 0, "<sec><title>Methods</title><p>deep</p></sec>").otherwise("")
    xml = F.concat(F.lit("<a><article-title>T"), k, F.lit("</article-title><body><sec><title>Intro</title><p>first <b>"), k, F.lit("</b>\n words</p>"), more, F.lit("</sec></body></a>"))
    broken = F.when(F.col("page_id") % 5 == 0, "<a><b>").otherwise(xml)
    return read(spark, sf_dir, "pages").select("page_id", literature.full_text_udf(broken).alias("body"))


# --- files and bookkeeping --------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role AS subreddit FROM conversations WHERE role IN ('user', 'system')")
def partitioned_scan(spark, sf_dir):
    """Partitions by bucket, written with a salt and scanned with the buckets of the wanted subreddits."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("subreddit"))
    path = shared(spark, "partitions")
    archives.write_partitions(rows.withColumns({"bucket": T.bucket(F.col("subreddit")), "content_type": F.lit("comments")}), path)
    return archives.scan(spark, path, ["user", "system"], ["conv_id", "turn", "subreddit", "no_such_column"])


@query("SELECT conv_id::VARCHAR || '_' || turn AS id, CASE WHEN turn % 3 = 2 THEN NULL ELSE turn::DOUBLE END AS score, conv_id::BIGINT AS created_utc FROM conversations")
def typed_archives(spark, sf_dir):
    """Compressed lines, numbers in quotes now and then, fields that nobody knows and lines that are broken."""
    rows = read(spark, sf_dir, "conversations")
    quoted = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), "turn", F.lit('"'))).when(F.col("turn") % 3 == 1, F.col("turn").cast("string")).otherwise('"n/a"')
    line = F.concat(F.lit('{"id":"'), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit('","score":'), quoted, F.lit(',"created_utc":"'), F.col("conv_id").cast("string"), F.lit('","more":[1]}'))
    path = shared(spark, "archives")
    rows.select(line.alias("value")).union(rows.limit(3).select(F.lit("{broken"))).write.option("compression", "gzip").text(f"{path}/deep/er")
    return archives.read_archives(spark, path).select("id", "score", "created_utc")


@query("SELECT n_name AS path FROM nation WHERE n_nationkey % 4 <> 0")
def manifest_resume(spark, sf_dir):
    """Files that no marker says are done; some are marked twice."""
    files = read(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), "n_nationkey")
    path = shared(spark, "manifest")
    finished = files.where("n_nationkey % 4 = 0")
    B.mark_done(finished, path)
    B.mark_done(finished.limit(2), path)
    return archives.unprocessed(files.select("path"), B.done(spark, path))


@query("SELECT 'forum' AS source, s.s_suppkey::VARCHAR AS nct_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS rows FROM supplier s")
def dataset_upsert(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    row = lambda path, n: [F.lit("forum").alias("source"), F.col("s_suppkey").cast("string").alias("nct_id"), F.lit(path).alias("path"), F.lit(n).cast("long").alias("rows")]
    return B.with_dataset(s.select(*row("old", 1)), s.where("s_suppkey % 2 = 0").select(*row("new", 2)))


@query("SELECT o_orderpriority AS run, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def appended_results(spark, sf_dir):
    """Two runs, of which one is repeated: its rows stand there once."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    path = shared(spark, "results")
    for run in ("1-URGENT", "2-HIGH", "1-URGENT"):
        B.append_results(orders.where(F.col("o_orderpriority") == run), path, run)
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT 'T' || (o_custkey % 20) AS nct_id, count(*) AS rows FROM orders GROUP BY 1")
def trial_files(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("T"), (F.col("o_custkey") % 20).cast("string")).alias("nct_id"), "o_orderkey")
    return B.write_by_trial(rows, shared(spark, "trials"))


@query("SELECT c_custkey, c_name FROM customer")
def curated_csv(spark, sf_dir):
    path = shared(spark, "curated") + ".csv"
    read(spark, sf_dir, "customer").select("c_custkey", "c_name").write.option("header", "true").option("escape", '"').csv(path)
    return B.read_curated(spark, path, "c_custkey long, c_name string")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cached' ELSE 'fetched' END AS body FROM pages")
def cached_texts(spark, sf_dir):
    wanted = read(spark, sf_dir, "pages").select("page_id")
    cache = wanted.where("page_id % 2 = 0").withColumn("body", F.lit("cached"))
    return literature.cached_lookup(wanted, cache, "page_id", lambda left: left.withColumn("body", F.lit("fetched")))
