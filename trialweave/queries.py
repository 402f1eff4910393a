"""The operators as queries over the driver's tables, each with the SQL that it should equal.

Reports are line items with their orders: the order's status stands for the trial, priority and a large quantity for
covariates, the return flag for the treatment, a discount above 0.05 for the outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import discretize as D
from trialweave.operators import estimators as E
from trialweave.operators import extraction as X
from trialweave.operators import forum, relational, results, trials
from trialweave.plans import estimate, study
from trialweave.sources import archives, literature

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """Six digits, and no negative zero."""
    return F.round(c, 6) + 0.0


KEYS, COVS = ["trial"], ["priority", "large"]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("trial"), F.col("o_orderpriority").alias("priority"))
    return lines.join(orders, "l_orderkey").select(
        "trial", "priority", (F.col("l_quantity") > 25).cast("int").alias("large"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("t"),
        (F.col("l_discount") > 0.05).cast("int").alias("y"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_discount",
    )


R_SQL = """
r AS (SELECT o_orderstatus AS trial, o_orderpriority AS priority, (l_quantity > 25)::INT AS large, l_quantity AS q,
             CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, (l_discount > 0.05)::INT AS y,
             l_orderkey, l_linenumber, l_discount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
arms AS (SELECT unnest([0, 1, 2]) AS arm),
cells AS (SELECT trial, priority, large, arm, count(*) AS n, count(*) FILTER (t = arm) AS nt, count(*) FILTER (t = arm AND y = 1) AS nty
          FROM r, arms GROUP BY ALL)"""
IPW_SQL = f"""{R_SQL},
apo AS (SELECT trial, arm, sum(CASE WHEN nt > 0 THEN n * ((nty / n) / (nt / n)) ELSE 0 END) / sum(n) AS apo FROM cells GROUP BY ALL)"""


def with_probs(df: DataFrame) -> DataFrame:
    cells = E.cell_probabilities(df, KEYS, COVS, "t", "y", 3)
    return df.join(cells.drop("n"), [*KEYS, *COVS])


def ipw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are a row each, so the second aggregate meets them where the first has left them."""
    cells = E.cell_probabilities(reports(spark, sf_dir), KEYS, COVS, "t", "y", 3)
    return E.ipw_potential_outcomes(cells, KEYS, COVS, "probs", 3, F.col("n"))


@query(f"WITH {IPW_SQL} SELECT trial, arm, round(apo, 6) AS apo FROM apo")
def ipw_apo(spark, sf_dir):
    return ipw(spark, sf_dir).select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"WITH {IPW_SQL} SELECT a.trial, a.arm AS arm_i, b.arm AS arm_j, round(b.apo - a.apo, 6) + 0.0 AS ate FROM apo a JOIN apo b ON a.trial = b.trial AND a.arm < b.arm")
def ipw_ate(spark, sf_dir):
    return E.treatment_effects(ipw(spark, sf_dir), KEYS).select("trial", "arm_i", "arm_j", r6(F.col("ate")).alias("ate"))


@query(f"WITH {IPW_SQL} SELECT trial, arm, round(apo, 6) AS apo FROM apo")
def ipw_individual_responses(spark, sf_dir):
    """The same by way of each row's responses."""
    apo = E.potential_outcomes(E.ipw_responses(with_probs(reports(spark, sf_dir)), KEYS, COVS, "probs", 3), KEYS, 3)
    return apo.select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"""WITH {R_SQL} SELECT trial, arm, CASE WHEN min(nt) > 0 THEN round(sum(n * nty / nt) / sum(n), 6) END AS apo FROM cells GROUP BY ALL""")
def oi_individual_responses(spark, sf_dir):
    df = reports(spark, sf_dir).withColumn("probs", F.array(1.0 - F.col("y"), F.col("y").cast("double")))
    apo = E.potential_outcomes(E.oi_responses(df, KEYS, COVS, "t", "probs", 3), KEYS, 3)
    return apo.select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"WITH {R_SQL} SELECT trial, priority, large, arm, round(nt / n, 6) AS prop FROM cells")
def propensity_cells(spark, sf_dir):
    cells = E.propensity(with_probs(reports(spark, sf_dir)), KEYS, COVS, "probs", 3)
    return cells.select("trial", "priority", "large", F.posexplode("prop").alias("arm", "prop")).withColumn("prop", r6(F.col("prop")))


@query(f"""WITH {R_SQL} SELECT trial, arm, CASE WHEN min(nt) > 0 THEN round(sum(n * nty / nt) / sum(n), 6) END AS apo FROM cells GROUP BY ALL""")
def oi_apo(spark, sf_dir):
    df = reports(spark, sf_dir).withColumn("probs", F.array(1.0 - F.col("y"), F.col("y").cast("double")))
    apo = E.oi_potential_outcomes(df, KEYS, COVS, "t", "probs", 3)
    return apo.select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"""WITH {R_SQL},
m AS (SELECT trial, avg(q) AS mq, avg(t) AS mt, avg(l_discount) AS md, covar_pop(q, q) AS qq, covar_pop(q, t) AS qt, covar_pop(t, t) AS tt,
             covar_pop(q, l_discount) AS qd, covar_pop(t, l_discount) AS td FROM r GROUP BY trial),
b AS (SELECT *, (qd * tt - td * qt) / (qq * tt - qt * qt) AS bq, (td * qq - qd * qt) / (qq * tt - qt * qt) AS bt FROM m)
SELECT trial, arm, round(md + bt * (arm - mt), 6) AS apo FROM b, arms""")
def mc_oi_apo(spark, sf_dir):
    df = E.linear_responses(reports(spark, sf_dir), KEYS, ["q"], "t", "l_discount", 3)
    return E.potential_outcomes(df, KEYS, 3).select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"""WITH {R_SQL},
m AS (SELECT trial, avg(q) AS mq, avg(t) AS mt, avg(l_discount) AS md, covar_pop(q, q) AS qq, covar_pop(q, t) AS qt, covar_pop(t, t) AS tt,
             covar_pop(q, l_discount) AS qd, covar_pop(t, l_discount) AS td FROM r WHERE t < 2 GROUP BY trial),
b AS (SELECT *, (td * qq - qd * qt) / (qq * tt - qt * qt) AS bt FROM m)
SELECT trial, arm, CASE WHEN arm < 2 THEN round(md + bt * (arm - mt), 6) END AS apo FROM b, arms""")
def mc_oi_absent_arm(spark, sf_dir):
    """No row reports the last arm, which so has no outcome, though a line could be drawn to it."""
    df = E.linear_responses(reports(spark, sf_dir).where("t < 2"), KEYS, ["q"], "t", "l_discount", 3)
    return E.potential_outcomes(df, KEYS, 3).select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query(f"""WITH {R_SQL.replace("o_orderpriority AS priority", "nullif(o_orderpriority, '5-LOW') AS priority")},
full_cells AS (SELECT * FROM cells WHERE priority IS NOT NULL)
SELECT trial, arm, CASE WHEN min(nt) > 0 THEN round(sum(n * nty / nt) / sum(n), 6) END AS apo FROM full_cells GROUP BY ALL""")
def complete_covariates(spark, sf_dir):
    df = reports(spark, sf_dir).withColumn("probs", F.array(1.0 - F.col("y"), F.col("y").cast("double"))).withColumn("priority", F.nullif("priority", F.lit("5-LOW")))
    apo = E.oi_potential_outcomes(estimate.complete(df, COVS, use_imputed_nones=False), KEYS, COVS, "t", "probs", 3)
    return apo.select("trial", "arm", r6(F.col("apo")).alias("apo"))


@query()
def mc_ipw_apo(spark, sf_dir):
    weights = E.logistic_weights(reports(spark, sf_dir), KEYS, ["large", "q"], "t", 3)
    got = E.observed_responses(weights, "t", "y", "weight", 3)
    return E.potential_outcomes(got, KEYS, 3, weights="weights").select("trial", "arm", F.round("apo", 3).alias("apo"))


@query(f"WITH {R_SQL} SELECT trial, t AS arm, round(avg(y), 6) AS apo FROM r GROUP BY ALL")
def naive_means(spark, sf_dir):
    return E.naive_means(reports(spark, sf_dir), KEYS, "t", "y").withColumn("apo", r6(F.col("apo")))


@query(f"WITH {R_SQL} SELECT trial, arm, round(sum(y * l_discount) FILTER (t = arm) / nullif(sum(l_discount) FILTER (t = arm), 0), 6) AS apo FROM r, arms GROUP BY ALL")
def inclusion_weighted_mean(spark, sf_dir):
    df = E.observed_responses(reports(spark, sf_dir).withColumn("one", F.lit(1.0)), "t", "y", "one", 3)
    out = E.potential_outcomes(df, KEYS, 3, F.col("l_discount"), weights="weights")
    return out.select("trial", "arm", r6(F.col("apo")).alias("apo"))


DRAW = "('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH o AS (SELECT o_orderstatus AS trial, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS k, o_totalprice AS v FROM orders),
n AS (SELECT trial, count(*) AS n FROM o GROUP BY trial),
d AS (SELECT trial, b, floor({DRAW.format("'7', b, trial, k")} * n)::BIGINT AS k FROM o JOIN n USING (trial), range(10) AS x(b)),
m AS (SELECT trial, b, count(*) AS rows, count(DISTINCT k) AS picked FROM d GROUP BY ALL)
SELECT trial, b::INT AS replicate, rows, picked FROM m""")
def bootstrap_draws(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("trial"), "o_orderkey", "o_totalprice")
    drawn = E.bootstrap(df, ["trial"], ["o_orderkey"], 10, 7)
    return drawn.groupBy("trial", "replicate").agg(F.sum("times").alias("rows"), F.count("*").alias("picked"))


@query("""WITH m AS (SELECT event_type AS k, extract(day FROM ts) % 10 AS b, avg(value) AS v FROM events GROUP BY ALL)
SELECT k, round(stddev_samp(v), 6) AS sd, round(1.959963984540054 * stddev_samp(v), 6) AS half_width FROM m GROUP BY k""")
def bootstrap_interval(spark, sf_dir):
    m = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), (F.dayofmonth("ts") % 10).alias("b")).agg(F.avg("value").alias("v"))
    return E.interval(m, ["k"], "v").select("k", r6(F.col("sd")).alias("sd"), r6(F.col("half_width")).alias("half_width"))


# --- votes, softmax, filters ------------------------------------------------------------------------------------------


@query(f"""WITH v AS (SELECT user_id, count(*) AS n_votes, avg((lower(event_type) = 'purchase')::INT) AS p FROM events GROUP BY user_id)
SELECT user_id, n_votes, round(1 - p, 6) AS p_no, round(p, 6) AS p_yes, CASE WHEN {DRAW.format("'3', user_id")} < p THEN 'Yes' ELSE 'No' END AS label FROM v""")
def vote_fraction(spark, sf_dir):
    votes = read(spark, sf_dir, "events").select("user_id", F.when(F.lower("event_type") == "purchase", "Yes").otherwise("No").alias("vote"))
    got = X.vote_fractions(votes, "user_id", "vote", 3)
    return got.select("user_id", "n_votes", r6(F.col("inclusion_probs")[0]).alias("p_no"), r6(F.col("inclusion_probs")[1]).alias("p_yes"), "label")


@query("SELECT c_custkey, v::INT AS vote FROM customer, range(25) AS x(v)")
def vote_requests(spark, sf_dir):
    return X.vote_requests(read(spark, sf_dir, "customer").select("c_custkey"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings),
x AS (SELECT vec_id, c, exp(s) AS e FROM e)
SELECT vec_id, c::INT AS combo, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM x""")
def softmax_rows(spark, sf_dir):
    long = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("combo", "score"))
    probs = X.conditional_probabilities(long.withColumn("score", F.col("score").cast("double")), "vec_id")
    return probs.select("vec_id", F.posexplode("probs").alias("combo", "p")).withColumn("p", r6(F.col("p")))


@query("SELECT vec_id, round(sum(s::DOUBLE * j), 5) + 0.0 AS expected FROM (SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) GROUP BY vec_id")
def expected_outcome(spark, sf_dir):
    p = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.round(V.expected_index(p), 5) + 0.0).alias("expected"))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'not_numeric' WHEN event_type IS DISTINCT FROM 'view' THEN 'other_basis'
 WHEN NOT value BETWEEN 1 AND 50 THEN 'out_of_bounds' ELSE 'keep' END AS verdict FROM events) GROUP BY verdict""")
def sampled_outcome_filter(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("v", X.outcome_verdict(F.col("value").cast("string"), F.col("event_type"), (1, 50), "view"))
    return df.groupBy(F.col("v").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F'")
def hard_filter(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("treatment_taken_filter"), F.when(F.col("l_linestatus") == "F", "Yes").otherwise("Unknown").alias("outcome_category_filter"))
    return X.treatment_outcome_known(df, ["A", "R"]).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click')")
def inclusion_filter(spark, sf_dir):
    said = F.when(F.col("event_type") == "view", "YES").when(F.col("event_type") == "click", "unknown").when(F.col("event_type") == "error", "No")
    return X.meets_inclusion(read(spark, sf_dir, "events").withColumn("meets_inclusion_criteria", said)).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def relevance_filter(spark, sf_dir):
    return X.relevant(read(spark, sf_dir, "events").withColumn("is_relevant", F.when(F.col("event_type") == "view", "Yes").otherwise("no"))).select("event_id")


@query("""SELECT event_id FROM events e LEFT JOIN (SELECT event_id, 'Yes' AS said FROM events WHERE value > 20) a USING (event_id)
WHERE CASE WHEN event_type = 'view' THEN 'Yes' ELSE coalesce(said, 'Unclear') END = 'Yes'""")
def ownership_gate(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    answers = events.where("value > 20").select("event_id", F.lit("Yes").alias("ownership"))
    return X.owned(events.withColumn("report_type", F.when(F.col("event_type") == "view", "submission").otherwise("comment")), answers, "event_id").select("event_id")


@query("SELECT (6 * a.k + 3 * b.k + c.k)::BIGINT AS combo, a.v AS t, b.v AS y, c.v AS x FROM (VALUES (0, 'A'), (1, 'B')) a(k, v), (VALUES (0, 'No'), (1, 'Yes')) b(k, v), (VALUES (0, 'l'), (1, 'm'), (2, 'h')) c(k, v)")
def answer_combinations(spark, sf_dir):
    return relational.combinations({"t": ["A", "B"], "y": ["No", "Yes"], "x": ["l", "m", "h"]}, spark)


@query("""SELECT coalesce(event_type, 'total') AS stage, sum((props->>'k')::BIGINT) AS tokens, round(sum(value), 2) AS cost, count(*) AS n FROM events GROUP BY ROLLUP (event_type)""")
def token_totals(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"))
    return relational.totals(df, "stage", "tokens", "cost").withColumn("cost", F.round("cost", 2))


# --- discretisation ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, (c_acctbal > (SELECT quantile_cont(c_acctbal, 0.5) FROM customer))::INT AS code FROM customer")
def discretize_median(spark, sf_dir):
    return D.median_codes(read(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "code")


@query("SELECT l_linestatus, (row_number() OVER (ORDER BY f) - 1)::INT AS code FROM (SELECT l_linestatus, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1)")
def discretize_few(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return D.first_seen_codes(df, "l_linestatus", "o")


TAIL_SQL = """WITH c AS (SELECT {v} AS v, count(*) AS n, min({o}) AS f FROM {t} WHERE {v} IS NOT NULL GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) - 1 AS k, sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, f ROWS UNBOUNDED PRECEDING) AS tail FROM c),
q AS (SELECT *, min(CASE WHEN tail <= n THEN k END) OVER () AS cut FROM p)
SELECT v AS {v}, n, (CASE WHEN k <= cut THEN k ELSE cut + 1 END)::INT AS code, CASE WHEN k <= cut THEN v ELSE 'Other' END AS label FROM q"""


@query(TAIL_SQL.format(v="lang", o="doc_id", t="documents"))
def discretize_tail_other(spark, sf_dir):
    return D.head_categories(read(spark, sf_dir, "documents"), "lang", "doc_id")


@query(TAIL_SQL.format(v="p_name", o="p_partkey", t="part"))
def discretize_tail_names(spark, sf_dir):
    return D.head_categories(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR lower(c_mktsegment) = 'building' THEN n_name ELSE c_mktsegment END AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def covariate_resolve(spark, sf_dir):
    df = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.lower("c_mktsegment") == "building", "Unknown").otherwise(F.col("c_mktsegment"))
    return df.select("c_custkey", D.resolved(value, F.col("n_name")).alias("segment"))


# --- text -------------------------------------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(replace(replace(replace(coalesce({}, ''), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"
_BARE = r"regexp_replace({}, '(?i)\[([^\]]+)\]\(\s*(?:https?://|www\.)\S+\s*\)|https?://\S+|\bwww\.\S+', '\1', 'g')"


def _mask(text: str, author: str) -> str:
    clean = _CLEAN.format(text)
    bare = _BARE.format(clean)
    return (
        rf"(length({clean}) > 0 AND {clean} NOT IN ('[deleted]', '[removed]') AND lower(coalesce({author}, '')) <> 'automoderator' "
        rf"AND NOT regexp_matches(lower(coalesce({author}, '')), '(?:^|[_-])bot\d*$') AND regexp_matches(substr({bare}, 1, 2048), '\p{{L}}{{3,}}') "
        rf"AND len(regexp_extract_all({bare}, '\p{{L}}')) * 4 >= length({bare}))"
    )


@query(f"SELECT page_id, {_mask('html', 'url')} AS keep FROM pages")
def rule_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.passes_rules(F.col("html"), F.col("url")).alias("keep"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {_mask("CASE WHEN turn = 0 THEN text END", "role")} THEN 'submissions'
WHEN {_mask("CASE WHEN turn > 0 THEN text END", "role")} THEN 'comments' ELSE 'unknown' END AS kind FROM conversations) GROUP BY kind""")
def content_type(spark, sf_dir):
    post, answer = F.when(F.col("turn") == 0, F.col("text")), F.when(F.col("turn") > 0, F.col("text"))
    kind = T.content_type(post, answer, F.col("role"))
    return read(spark, sf_dir, "conversations").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n), '\b\d+(\.\d+)?\s*(mg|g|ml|mcg|µg|kg|units?)\b', '', 'g'),
 '\b(oral|tablet|capsule|injection|iv|intravenous|subcutaneous|sc|placebo)\b', '', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name
FROM (SELECT p_partkey, p_name || ' ' || p_size || ' mg Oral-Tablet (' || p_type || ')' AS n FROM part)""")
def normalize_treatment(spark, sf_dir):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg Oral-Tablet ("), "p_type", F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_treatment(name).alias("name"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_size || ' mg tablet', '\s+\d+([./]\d+)*\s*(mg|g|mcg|ug|ml|iu|units|tablets?|capsules?)?\b.*$', '', 'i')) AS name FROM part""")
def drug_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.drug_name(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg tablet"))).alias("name"))


@query(r"SELECT p_partkey, regexp_matches('Percentage of ' || p_name, '(?i)\b(number|count|proportion|percentage|percent|rate|fraction)\s+of\s+(participants|subjects|patients|individuals|people|volunteers|enrollees)\b') OR p_size % 2 = 0 AS is_binary FROM part")
def binary_endpoint(spark, sf_dir):
    title = F.when(F.col("p_size") % 2 == 0, F.lit("Number of Participants with response")).otherwise(F.concat(F.lit("Percentage of "), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.is_binary_endpoint(title).alias("is_binary"))


@query(r"""SELECT doc_id, '/r/' || source || '/comments/' || doc_id || '/' || regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') || '/' AS post,
 '/r/' || source || '/comments/' || doc_id || '/_/' || n_chars AS answer FROM documents""")
def permalink_slug(spark, sf_dir):
    i, c = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    link = T.post_id(F.concat(F.lit("t3_"), i))
    return read(spark, sf_dir, "documents").select("doc_id", T.submission_permalink(F.col("source"), link, F.col("text")).alias("post"), T.comment_permalink(F.col("source"), link, c).alias("answer"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE sha256('trialweave:forum:author:1:' || lower(role)) END AS author_key FROM conversations""")
def author_pseudonym(spark, sf_dir):
    name = F.when(F.col("role") == "system", "[deleted]").otherwise(F.concat(F.lit(" "), F.initcap("role"), F.lit(" ")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.author_key(name).alias("author_key"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' WHEN turn = 0 THEN '**Source**' || chr(10) || 'r/x, ' || conv_id || ', ' || turn || chr(10) || chr(10) || '**Written by the author**' || chr(10) || 'Title: ' || role || chr(10) || chr(10) || text
 ELSE '**Source**' || chr(10) || 'r/x, ' || conv_id || ', ' || turn || chr(10) || chr(10) || '**Written by someone else, for context**' || chr(10) || 'Title: ' || role || chr(10) || chr(10) || chr(10) || chr(10) || '**Written by the author**' || chr(10) || text END AS report FROM conversations""")
def report_markdown(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "other").when(F.col("turn") == 0, "submission").otherwise("comment")
    out = T.report_markdown(kind, F.lit("x"), F.col("conv_id"), F.col("turn"), F.col("role"), F.lit(None), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("report"))


_PII = [f"'{p}', '<{n}>', 'g'" for n, p in T.PATTERN_ENTITIES]
_ANON = "text"
for _step in _PII:
    _ANON = f"regexp_replace({_ANON}, {_step})"


@query(f"SELECT doc_id, {_ANON} AS text FROM documents")
def anonymize_patterns(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.anonymized(F.col("text")).alias("text"))


_KINDS = [n for n, _ in T.PATTERN_ENTITIES]


@query(f"""SELECT entity, (len(regexp_extract_all(t, '<' || entity || '>')))::BIGINT AS n FROM (SELECT string_agg({_ANON}, ' ') AS t FROM documents), unnest({_KINDS}) AS u(entity)""")
def entity_counts(spark, sf_dir):
    sums = read(spark, sf_dir, "documents").agg(*[F.sum(T.entity_count(F.col("text"), k)).alias(k) for k in _KINDS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("entity"), F.col(k).cast("long").alias("n")) for k in _KINDS])).alias("x")).select("x.*")


@query("SELECT source, ceil(9604.0 / (1 + 9603.0 / count(*)))::BIGINT AS n FROM documents GROUP BY source")
def anonymizer_sample_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(T.sample_size(F.count("*")).alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name) || p_size || 'mg_' || lower(p_type) || '--x1', '(\d)([a-z])', '\1 \2', 'g'), '([a-z])(\d)', '\1 \2', 'g'), '[-_/+,;:\s]+', ' ', 'g'), '^ +| +$', '', 'g') AS name FROM part""")
def spaced_numbers(spark, sf_dir):
    text = F.concat(F.lower("p_name"), F.col("p_size").cast("string"), F.lit("mg_"), F.lower("p_type"), F.lit("--x1"))
    return read(spark, sf_dir, "part").select("p_partkey", T.spaced_numbers(text).alias("name"))


@query()
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_alias_udf(F.col("text")).alias("alias_form"), T.normalize_forum_udf(F.col("text")).alias("forum_form"))


ALIASES = ("idiot", "trash", "license", "public license", "version 3", "apache", "worthless", "example", "ther", "ldn")
_ALIAS_SQL = f"SELECT unnest({list(ALIASES)}) AS alias"


@query(f"""SELECT doc_id, alias FROM documents, ({_ALIAS_SQL}) WHERE CASE WHEN alias = 'ldn' THEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])ldn($|[^\\p{{L}}\\p{{N}}])') ELSE contains(lower(text), alias) END""")
def alias_match(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return forum.alias_matches(docs, spark.createDataFrame([(a,) for a in ALIASES], "alias string"), "text", "doc_id")


_HAS = "CASE WHEN alias = 'ldn' THEN regexp_matches({0}, '(^|[^\\p{{L}}\\p{{N}}])ldn($|[^\\p{{L}}\\p{{N}}])') ELSE contains({0}, alias) END"


@query(f"SELECT doc_id, alias FROM documents, ({_ALIAS_SQL}) WHERE {_HAS.format('lower(text)')}")
def alias_automaton(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    matcher = spark.sparkContext.broadcast(T.Matcher(ALIASES))
    return docs.select("doc_id", F.explode(forum.mentions(F.col("text"), matcher)).alias("alias"))


_SPELLED = r"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '(\d)([a-z])', '\1 \2', 'g'), '([a-z])(\d)', '\1 \2', 'g'), '[-_/+,;:\s]+', ' ', 'g')"
_ROUTE = {"N0": 400, "N1": 700, "N2": 100000}


@query(f"""WITH a AS (SELECT alias, 'N' || (row_number() OVER (ORDER BY alias) % 3) AS nct_id FROM ({_ALIAS_SQL})),
c AS (SELECT * FROM (VALUES ('N0', 400), ('N1', 700), ('N2', 100000)) v(nct_id, cutoff)),
d AS (SELECT doc_id, {_SPELLED} AS t FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY source LIMIT 3))
SELECT nct_id, doc_id, string_agg(alias, ',' ORDER BY alias) AS treatments FROM d JOIN a ON {_HAS.format('t')} JOIN c USING (nct_id) WHERE doc_id <= cutoff GROUP BY ALL""")
def alias_route(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    named = spark.createDataFrame([(a, f"N{k % 3}", _ROUTE[f"N{k % 3}"]) for k, a in enumerate(sorted(ALIASES), 1)], "alias string, nct_id string, cutoff long")
    forums = docs.select(F.col("source").alias("subreddit")).distinct().orderBy("subreddit").limit(3)  # the forums that the trials are about
    reg = forum.registry(named.select("nct_id", "alias"), forums.withColumn("nct_id", F.explode(F.lit(sorted(_ROUTE)))), named.select("nct_id", "cutoff").distinct())
    records = docs.select(F.col("source").alias("subreddit"), F.col("doc_id").alias("date"), F.col("doc_id").cast("string").alias("permalink"), "text")
    got = forum.routed(records, reg, spark.sparkContext.broadcast(T.Matcher(ALIASES)))
    return got.select("nct_id", F.col("date").alias("doc_id"), F.array_join("treatments_mentioned", ",").alias("treatments"))


# --- joins, dedupe, dates ---------------------------------------------------------------------------------------------


@query("""SELECT e.event_id, event_type FROM events e JOIN (SELECT event_type, max(ts) - INTERVAL 5 DAY AS cutoff FROM events GROUP BY 1) c USING (event_type) WHERE ts <= cutoff""")
def date_gate(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    cut = events.groupBy("event_type").agg((F.max("ts") - F.expr("interval 5 days")).alias("cutoff"))
    return forum.date_gated(events, cut, "ts", "event_type", "cutoff").select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) - INTERVAL 5 DAY FROM events)")
def strict_date_gate(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts", F.lit(1).alias("k"))
    cut = events.groupBy("k").agg((F.max("ts") - F.expr("interval 5 days")).alias("cutoff"))
    return forum.date_gated(events, cut, "ts", "k", "cutoff", inclusive=False).select("event_id")


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('second', ts) ELSE (CASE WHEN event_id % 5 = 1 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END) END::TIMESTAMP AS parsed FROM events""")
def date_parse(spark, sf_dir):
    ts, k = F.col("ts"), F.col("event_id") % 5
    text = F.when(k == 0, F.date_format(ts, "MMMM dd, yyyy")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(ts, "yyyy-MM-dd"))
    text = text.when(k == 3, F.unix_timestamp(ts).cast("string")).otherwise("no date")
    return read(spark, sf_dir, "events").select("event_id", V.forum_time(text).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '9999-12-31' END AS cutoff, strftime(ts, '%B %d, %Y') AS shown FROM events")
def trial_cutoff(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(V.trial_cutoff(text), "yyyy-MM-dd").alias("cutoff"), V.forum_date_text(F.unix_timestamp("ts")).alias("shown"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0""")
def resume_anti_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return relational.resumed(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey")[0]


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 2), o_orderkey) = 1""")
def upsert_keep_first(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderkey"])


@query("""SELECT k, rank_total, n FROM (SELECT event_type AS k, sum(r)::BIGINT AS rank_total, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r FROM events) GROUP BY 1)""")
def distributed_rank(spark, sf_dir):
    got = relational.ranked(read(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])
    return got.groupBy(F.col("event_type").alias("k")).agg(F.sum("rank").cast("long").alias("rank_total"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderpriority, o_totalprice AS pred, abs_error FROM (SELECT o_custkey, o_orderpriority, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN abs(o_totalprice - 100000) END AS abs_error,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1 AND abs_error IS NOT NULL""")
def results_collect(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("pred"), F.when(F.col("o_orderstatus") != "P", F.abs(F.col("o_totalprice") - 100000)).alias("abs_error"))
    return results.collected(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_custkey", "o_orderpriority", "pred", "abs_error"])


@query("""SELECT c_custkey, c_acctbal AS pred, s_acctbal AS truth, round(abs(c_acctbal - s_acctbal), 6) AS abs_error FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def truth_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("pred"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("truth"))
    return results.with_truth(c, s, ["c_custkey"]).withColumn("abs_error", r6(F.col("abs_error")))


@query("SELECT count(*) FILTER (n > 0) AS over_0, count(*) FILTER (n > 10) AS over_10, count(*) FILTER (n > 100) AS over_100 FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def threshold_histogram(spark, sf_dir):
    return results.over_thresholds(read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n", (0, 10, 100))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean_apo, round(avg(abs(p_retailprice)), 6) AS mean_abs_ate FROM part GROUP BY p_brand")
def truth_means(spark, sf_dir):
    return results.mean_truth(read(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_brand", r6(F.col("mean_apo")).alias("mean_apo"), r6(F.col("mean_abs_ate")).alias("mean_abs_ate"))


# --- threads and authors ----------------------------------------------------------------------------------------------


def _thread(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("post_id"),
        F.when(F.col("role") != "system", F.col("role")).alias("author_key"), F.lit("s").alias("subreddit"), F.col("text").alias("body"), F.lit(1.0).alias("score"), F.col("turn").alias("timestamp"), "turn",
    )
    posts = c.where("turn = 0").select("post_id", "author_key", "subreddit", F.lit("A Title").alias("title"), F.col("body").alias("selftext"), "score", "timestamp")
    return posts, c.where("turn > 0").drop("turn")


_THREAD_SQL = r"""WITH c AS (SELECT conv_id, turn, nullif(role, 'system') AS a, text FROM conversations),
p AS (SELECT conv_id, a, text FROM c WHERE turn = 0),
o AS (SELECT c.conv_id, string_agg(chr(10) || '> ' || c.text, '' ORDER BY turn, c.conv_id || '_' || turn) AS q, count(*) AS n FROM c JOIN p ON c.conv_id = p.conv_id AND c.a = p.a WHERE turn > 0 GROUP BY 1),
e AS (SELECT p.conv_id, p.a, CASE WHEN n > 0 THEN text || chr(10) || chr(10) || 'In the same thread, the author of this post added:' || q ELSE text END AS rich, coalesce(n, 0) AS n FROM p LEFT JOIN o USING (conv_id))
SELECT '/r/s/comments/' || conv_id || '/a_title/' AS permalink, 'submission' AS report_type, a AS author_key, '' AS initial_post, rich AS report_text, n AS replies FROM e
UNION ALL SELECT '/r/s/comments/' || c.conv_id || '/_/' || c.conv_id || '_' || turn, 'comment', c.a, e.rich, c.text, 0 FROM c LEFT JOIN e ON c.conv_id = e.conv_id
WHERE turn > 0 AND (c.a IS NULL OR e.a IS NULL OR c.a <> e.a)"""


@query(_THREAD_SQL)
def thread_context(spark, sf_dir):
    got = forum.contextualized(*_thread(spark, sf_dir))
    return got.select("permalink", "report_type", "author_key", "initial_post", "report_text", F.size("author_replies").cast("long").alias("replies"))


@query(r"""WITH e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id::VARCHAR END AS a, ts, event_type, CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'p' || (event_id // 22) ELSE 'q' || event_id END AS p FROM events),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY CASE WHEN p = '' THEN 'row:' || event_id ELSE p END ORDER BY date_trunc('day', ts), p, event_id) = 1),
k AS (SELECT *, coalesce(a, 'unkeyed:' || event_id) AS g FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY date_trunc('day', ts), p, event_id) AS r FROM k)
SELECT a AS author_key, first(event_id ORDER BY r) AS row_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS treatments, count(*) AS source_record_count,
 CASE WHEN a IS NOT NULL THEN '# All records of one pseudonymous author' || chr(10) || chr(10) || 'Only what is marked as written by the author is theirs; everything else is context.' || chr(10) || chr(10) ELSE '' END
 || string_agg('## Authored record ' || r || chr(10) || chr(10) || event_type, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS report
FROM n GROUP BY g, a""")
def author_aggregate(spark, sf_dir):
    i = F.col("event_id")
    link = F.when(i % 50 == 0, "").when(i % 11 == 0, F.concat(F.lit("p"), F.floor(i / 22).cast("string"))).otherwise(F.concat(F.lit("q"), i.cast("string")))
    df = read(spark, sf_dir, "events").select(
        i.alias("row_id"), F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("author_key"), F.date_format("ts", "MMMM dd, yyyy").alias("date_created"),
        link.alias("permalink"), F.lit("s").alias("subreddit"), F.col("event_type").alias("report"), F.array("event_type").alias("treatments_mentioned"),
    )
    got = forum.by_author(df)
    return got.select("author_key", "row_id", F.array_join("treatments_mentioned", ",").alias("treatments"), "source_record_count", "report")


# --- trials -----------------------------------------------------------------------------------------------------------


@query("""SELECT count(*) FILTER (a) AS randomized, count(*) FILTER (a AND b) AS arms, count(*) FILTER (a AND b AND c) AS binary_end, count(*) AS trials
FROM (SELECT p_size > 10 AS a, p_type <> 'SMALL' AS b, p_retailprice > 1000 AS c FROM part)""")
def funnel(spark, sf_dir):
    steps = {"randomized": F.col("p_size") > 10, "arms": F.col("p_type") != "SMALL", "binary_end": F.col("p_retailprice") > 1000}
    return trials.funnel_counts(trials.funnel(read(spark, sf_dir, "part"), steps), list(steps))


@query("SELECT p_partkey FROM part WHERE list_bool_or(list_transform(string_split(lower(p_name), ' '), lambda t: contains(t, 'ring') OR contains('ring', t) OR contains(t, 'red widget') OR contains('red widget', t)))")
def condition_match(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("terms", F.split(F.upper("p_name"), " "))
    return part.where(trials.matches_condition(F.col("terms"), F.lit(["ring", "Red_Widget"]))).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY d NULLS LAST, o_orderkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS d FROM orders)""")
def temporal_split(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("d"))
    return trials.temporal_split(o, "d", "o_orderkey").select("o_orderkey", "split")


@query("""WITH a AS (SELECT p_brand, p_type, avg(p_retailprice) AS v, min(p_partkey) AS o FROM part GROUP BY ALL)
SELECT x.p_brand, x.p_type AS arm_i, y.p_type AS arm_j, round(y.v - x.v, 6) + 0.0 AS effect FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.o < y.o AND lower(x.p_type) <> lower(y.p_type)""")
def pairwise_effects(spark, sf_dir):
    arms = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"), F.min("p_partkey").alias("o"))
    return trials.pairs(arms, ["p_brand"], "o", "p_type", "v").withColumn("effect", r6(F.col("effect")))


@query("""SELECT p_partkey, round(CASE WHEN p_type = 'SMALL' THEN p_retailprice / 100 WHEN p_type = 'ECONOMY' THEN p_retailprice / nullif(p_size, 0) ELSE p_retailprice END, 6) AS v FROM part""")
def outcome_normalize(spark, sf_dir):
    unit = F.when(F.col("p_type") == "SMALL", "Percentage of x").otherwise("points")
    param = F.when(F.col("p_type") == "ECONOMY", "NUMBER").otherwise("MEAN")
    return read(spark, sf_dir, "part").select("p_partkey", r6(V.normalized_outcome(F.col("p_retailprice"), F.col("p_size").cast("double"), unit, param)).alias("v"))


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_name")
def covariate_frequency(spark, sf_dir):
    return trials.covariate_frequency(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT CASE WHEN p_size <= 25 THEN 'train' ELSE 'val' END AS split, count(DISTINCT p_brand) AS trials, count(DISTINCT p_name) AS arms, count(DISTINCT p_type) AS outcomes, count(*) AS labels FROM part GROUP BY 1")
def distinct_counts(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("nct_id"), F.when(F.col("p_size") <= 25, "train").otherwise("val").alias("split"), F.col("p_name").alias("arm"), F.col("p_type").alias("outcome"))
    # a trial of the table stands in both splits, so its split is part of its id
    part = part.withColumn("nct_id", F.concat_ws("/", "split", "nct_id"))
    return study.counts(study.Study(part.select("nct_id", "split").distinct(), part.drop("split"), None, None, None))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def active_arms(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "EXPERIMENTAL").when(F.col("p_type") == "SMALL", "PLACEBO_COMPARATOR")
    return read(spark, sf_dir, "part").where(trials.is_active(kind)).select("p_partkey")


@query("""SELECT query, string_agg(DISTINCT brand, ',' ORDER BY brand) AS trials FROM (SELECT p_brand AS brand, p_type || ' AND (' || array_to_string(list_sort(list_distinct([lower(p_name), 'x'])), ' OR ') || ') AND ((fha[Filter]) AND (casereports[Filter]) AND (humans[Filter]) AND (english[Filter]))' AS query FROM part) GROUP BY query""")
def query_fan_out(spark, sf_dir):
    q = read(spark, sf_dir, "part").select(F.col("p_brand").alias("nct_id"), literature.search_query(F.col("p_type"), F.array("p_name", F.lit("X"))).alias("query"))
    return literature.query_fan_out(q).select("query", F.array_join("nct_ids", ",").alias("trials"))


@query(r"""SELECT page_id, t AS title, t || chr(10) || chr(10) || a AS report FROM (SELECT page_id, nullif(trim(regexp_replace(url, '"{2,}', '"', 'g')), '') AS t,
 nullif(trim(regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'No abstract available' ELSE html END, '"{2,}', '"', 'g')), '') AS a FROM pages) WHERE a IS NOT NULL AND lower(a) <> 'no abstract available'""")
def pubmed_clean(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), F.when(F.col("page_id") % 3 == 0, "No abstract available").otherwise(F.col("html")).alias("abstract"))
    return literature.cleaned(p).select("page_id", "title", "report")


@query("SELECT substr(md5(string_agg(n_name, '' ORDER BY n_name)), 1, 12) AS digest FROM nation")
def input_digest(spark, sf_dir):
    return archives.input_digest(read(spark, sf_dir, "nation").select(F.col("n_name").alias("path")))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    from trialweave.source_queries import shared
    from trialweave.streaming import ingest

    schema = read(spark, sf_dir, "events").schema
    out, at = shared(spark, "stream"), shared(spark, "offsets")
    stream = ingest.stream_files(spark, f"{sf_dir}/events.parquet", schema, "parquet")
    stream.select("event_type", "value").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))


from trialweave import source_queries  # noqa: E402, F401  (registers the queries of sources, stages and bookkeeping)
