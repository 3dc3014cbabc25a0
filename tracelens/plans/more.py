"""Queries for further operators of each family, with their SQL twins. Importing this module registers them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, entropy, prompts, text, verdicts
from ..operators import generate, groups, losses, metrics, quality, segment, select
from ..sources import schemas, tables
from ..streaming import resume
from . import views
from .queries import _T, _TRIM, SQL, query, rounded
from .views import C, H, literal

_WS = "E' \\t\\n\\r'"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files: in spark.checkpoint.dir, which driver and executors share, or in local mode where it is unset in a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- accuracy ------------------------------------------------------------------------------------------------------


def _samples(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers with a made-up gold answer and direct prediction, and events as their candidates."""
    q = F.col("c_custkey")
    direct = F.when(q % 4 == 0, None).when(q % 4 == 1, "").otherwise(F.concat(F.lit("$"), ((q * 3) % 7).cast("string"), F.lit(".0")))
    s = views.read(spark, sf, "customer").select(q.alias("q"), (q % 7).cast("string").alias("gold"), direct.alias("direct"))
    e = F.col("event_id")
    pred = F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit(" "), (e % 7).cast("string"), F.lit(".00 ")))
    return s, views.read(spark, sf, "events").select(F.col("user_id").alias("q"), (e % 5).alias("idx"), e.alias("pos"), pred.alias("pred"))


_S = """s AS (SELECT c_custkey AS q, c_custkey % 7 AS gold, CASE WHEN c_custkey % 4 >= 2 THEN (c_custkey * 3) % 7 END AS direct FROM customer),
f AS (SELECT user_id AS q, arg_min(CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id % 7 END, {'z': event_id % 5 <> 0, 'p': event_id}) AS p FROM events GROUP BY user_id)"""


@query(f"""WITH {_S}, g AS (SELECT s.*, coalesce(direct, nullif(p, -1)) AS d FROM s LEFT JOIN f USING (q))
SELECT 'as_is' AS method, round(avg((direct = gold)::INT), 6) AS accuracy, count(direct) AS n FROM g UNION ALL SELECT 'filled', round(avg((d = gold)::INT), 6), count(d) FROM g""")
def direct_accuracy(spark, sf):
    s, c = _samples(spark, sf)
    return rounded(metrics.stacked(as_is=metrics.direct_accuracy(s), filled=metrics.direct_accuracy(metrics.filled_direct(s, c))))


@query(f"WITH {_S} SELECT round(avg((p = gold)::INT), 6) AS accuracy, count(*) AS n FROM s JOIN f USING (q)")
def cot_accuracy(spark, sf):
    return rounded(metrics.cot_accuracy(*_samples(spark, sf)))


@query("SELECT round(avg((p_partkey % 3 <> 0)::INT), 6) AS direct_self_agreement, count(*) AS n FROM part")
def self_agreement(spark, sf):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(".5"))).otherwise(F.concat(F.lit("$"), size, F.lit(".0.")))
    return rounded(metrics.self_agreement(views.read(spark, sf, "part"), answers.score_form(raw), answers.score_form(size)))


# --- entropy, tokens, steps ----------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT vec_id, round(avg(v) FILTER (i % 9 <> 0 AND vec_id % 50 <> 0), 6) AS mean, round(max(v) FILTER (i % 9 <> 0 AND vec_id % 50 <> 0), 6) AS max, round(avg(v) FILTER (i % 5 <> 0), 6) AS known FROM x GROUP BY vec_id""")
def entropy_summary(spark, sf):
    v = F.col("embedding").cast("array<double>")
    some = F.when(F.col("vec_id") % 50 == 0, F.array().cast("array<double>")).otherwise(F.transform(v, lambda x, i: F.when(i % 9 == 0, float("nan")).otherwise(x)))
    known = entropy.mean_known(F.transform(v, lambda x, i: F.when(i % 5 != 0, x)))
    e = views.read(spark, sf, "embeddings").select("vec_id", entropy.entropy_summary(some).alias("s"), known.alias("known"))
    return rounded(e.select("vec_id", text.json_safe(F.col("s.mean")).alias("mean"), text.json_safe(F.col("s.max")).alias("max"), "known"))


@query("""WITH e AS (SELECT vec_id, [abs(x::DOUBLE) FOR x IN embedding[1:5]] AS a FROM embeddings), t AS (SELECT vec_id, unnest(a) AS a FROM e),
h AS (SELECT vec_id, a, 1 / (1 + exp(-a)) AS p FROM t)
SELECT vec_id, (vec_id * 3)::VARCHAR AS answer, count(*) AS n_tokens, round(sum(-a), 6) AS logprob, round(sum(-(p * ln(p) + (1 - p) * ln(1 - p))), 6) AS entropy FROM h GROUP BY vec_id""")
def response_candidates(spark, sf):
    a = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")))
    alternatives = lambda x: F.array(*[F.struct(F.lit(n).alias("token"), v.alias("logprob")) for n, v in (("a", -x), ("b", -x * 2))])
    tokens = F.transform(a, lambda x: F.struct(F.lit("t").alias("token"), (-x).alias("logprob"), alternatives(x).alias("top_logprobs")))
    message = F.struct(F.concat(F.lit(" We count.\n#### "), (F.col("vec_id") * 3).cast("string"), F.lit(".00 ")).alias("content"))
    choice = F.struct(message.alias("message"), F.struct(tokens.alias("content")).alias("logprobs"))
    e = views.read(spark, sf, "embeddings").select("vec_id", F.to_json(F.struct(F.array(choice).alias("choices"))).alias("response"))
    c = e.select("vec_id", F.explode(generate.response_candidates(F.col("response"))).alias("c")).select("vec_id", F.col("c.predicted_answer_normalized").alias("answer"), F.explode("c.tokens").alias("t"))
    return rounded(c.groupBy("vec_id", "answer").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("t.logprob").alias("logprob"), F.sum("t.entropy").alias("entropy")))


_PIECES = r"(?s).*?[.!?]+(?:\s+|\z)|(?s).+\z"


@query(rf"""WITH d AS (SELECT doc_id, trim(text, {_WS}) AS t FROM documents), w AS (SELECT doc_id, t, [length(x) FOR x IN string_split_regex(t, '\s+') IF x <> ''] AS l, regexp_extract_all(t, '{_PIECES}') AS ps FROM d),
p AS (SELECT doc_id, l, length(t) AS c, len(l) AS n, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM w),
s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
k AS (SELECT doc_id, l, n, least(n, floor(s * n / c::DOUBLE))::INT AS t0, least(n, ceil((s + length(piece)) * n / c::DOUBLE))::INT AS t1 FROM s WHERE trim(piece, {_WS}) <> ''),
m AS (SELECT doc_id, l, t0, CASE WHEN t0 = t1 AND t1 < n THEN t1 + 1 ELSE t1 END AS t1 FROM k),
a AS (SELECT doc_id, t0, t1, list_avg([ln(x) FOR x IN l[t0 + 1:t1]]) AS mean, list_max([ln(x) FOR x IN l[t0 + 1:t1]]) AS top FROM m)
SELECT doc_id, count(*) AS n_steps, sum(t0)::BIGINT AS starts, sum(t1)::BIGINT AS ends, round(sum(mean), 4) AS mean_entropy, round(max(top), 6) AS max_entropy FROM a GROUP BY doc_id""")
def step_features(spark, sf):
    """Candidates with word entropies and the steps of their sentences; of a candidate only what these need."""
    d = tables.spread(views.read(spark, sf, "documents").select("doc_id", "text"), fine=True)
    d = d.select("doc_id", generate.bare_candidates(F.array("text")).alias("c"))
    d = d.select("doc_id", generate.with_steps(generate.with_entropy(F.col("c"), "per_word_uniform")).alias("c")).select("doc_id", F.explode_outer(F.col("c")[0]["steps"]).alias("s")).where("s is not null")  # `explode` would have the steps made again, twice, in a filter for rows that have some
    out = d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("s.start_token").alias("starts"), F.sum("s.end_token").alias("ends"), F.round(F.sum("s.mean_entropy"), 4).alias("mean_entropy"), F.round(F.max("s.max_entropy"), 6).alias("max_entropy")
    )
    return out


_HEADER = r"(?mi)(?:^|\n)\s*Step\s+\d+\b"


@query(rf"""WITH x AS (SELECT doc_id, 'Intro ' || doc_id || E'\nStep 1: ' || text || E'\n  step 22 ' || lang || E'\n\nSTEP 3' AS t FROM documents),
y AS (SELECT doc_id, t, regexp_extract_all(t, '{_HEADER}') AS h, string_split_regex(t, '{_HEADER}') AS g FROM x)
SELECT doc_id, (len(h) + 1)::BIGINT AS n_spans, length(g[1])::BIGINT AS first_end, (length(t) - length(h[-1] || g[-1]))::BIGINT AS last_start, length(t)::BIGINT AS last_end FROM y""")
def step_headers(spark, sf):
    t = F.concat(F.lit("Intro "), F.col("doc_id").cast("string"), F.lit("\nStep 1: "), F.col("text"), F.lit("\n  step 22 "), F.col("lang"), F.lit("\n\nSTEP 3"))
    return _ends(views.read(spark, sf, "documents").select("doc_id", segment.reasoning_spans(t).alias("s")))


def _ends(df: DataFrame) -> DataFrame:
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    return df.select("doc_id", F.size("s").cast("long").alias("n_spans"), first["e"].cast("long").alias("first_end"), last["s"].cast("long").alias("last_start"), last["e"].cast("long").alias("last_end"))


@query(rf"""WITH x AS (SELECT doc_id, lang || E'\n\n' || replace(text, '. ', E'.\n \n') || E'\n\n\n' || source AS t, source FROM documents),
y AS (SELECT doc_id, t, source, lang_end, [p FOR p IN string_split_regex(t, '\n\s*\n+') IF trim(p, {_WS}) <> ''] AS k FROM (SELECT *, strpos(t, E'\n') - 1 AS lang_end FROM x))
SELECT doc_id, len(k)::BIGINT AS n_spans, lang_end::BIGINT AS first_end, (length(t) - length(source))::BIGINT AS last_start, length(t)::BIGINT AS last_end FROM y""")
def paragraph_spans(spark, sf):
    t = F.concat("lang", F.lit("\n\n"), F.replace("text", F.lit(". "), F.lit(".\n \n")), F.lit("\n\n\n"), "source")
    return _ends(views.read(spark, sf, "documents").select("doc_id", segment.reasoning_spans(t).alias("s")))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50)::DOUBLE AS s0, (l_partkey % 50 + l_suppkey % 4 - 1)::DOUBLE AS e0, (l_linenumber * 5) % 11 AS n, CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE 40 END AS c FROM lineitem),
y AS (SELECT *, greatest(0, least(s0, c)) AS s, greatest(0, least(e0, c)) AS e FROM x), z AS (SELECT *, least(n, greatest(0, round_even(s * n / c, 0))) AS mid, least(n, floor(s * n / c)) AS a, least(n, ceil(e * n / c)) AS b FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN n = 0 OR c = 0 THEN 0 WHEN e <= s THEN mid ELSE a END)::INT AS t0, (CASE WHEN n = 0 THEN 0 WHEN c = 0 THEN least(1, n) WHEN e <= s THEN mid WHEN a = b AND b < n THEN b + 1 ELSE b END)::INT AS t1 FROM z""")
def token_spans(spark, sf):
    s = F.col("l_partkey") % 50
    e = s + F.col("l_suppkey") % 4 - 1
    n, c = ((F.col("l_linenumber") * 5) % 11).cast("int"), F.when(F.col("l_orderkey") % 13 == 0, 0).otherwise(40)
    i = views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.cast("int").alias("s"), e.cast("int").alias("e"), n.alias("n"), c.alias("c"))
    i = i.withColumn("t", segment.token_span(F.col("s"), F.col("e"), F.col("c"), F.col("n")))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t.t0", "t.t1")


@query("""WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v, embedding FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT vec_id, max(v) AS top, any_value(embedding)[vec_id % 64 + 1]::DOUBLE AS hit FROM x GROUP BY vec_id)
SELECT vec_id, sum(i)::BIGINT AS places, round(sum(v), 6) AS logprob, round(sum(abs(v)), 6) AS entropy, round(ln(sum(exp(v - top))) + any_value(top) - any_value(hit), 6) AS ce FROM x JOIN m USING (vec_id) GROUP BY vec_id""")
def token_features(spark, sf):
    v = F.col("embedding").cast("array<double>")
    e = views.read(spark, sf, "embeddings").select("vec_id", entropy.token_features(v, F.transform(v, F.abs)).alias("t"), entropy.cross_entropy(v, F.col("vec_id") % 64).alias("ce"))
    t = e.select("vec_id", "ce", F.explode("t").alias("t")).groupBy("vec_id", "ce")
    return rounded(t.agg(F.sum("t.token_index").alias("places"), F.sum("t.logprob").alias("logprob"), F.sum("t.entropy").alias("entropy")))


@query("""WITH x AS (SELECT vec_id, range(0, vec_id % 13) AS p, range(100, 100 + vec_id % 12) AS c FROM embeddings), y AS (SELECT *, 10 - len(c) AS room, p || c AS whole FROM x)
SELECT vec_id, CASE WHEN room > 0 AND len(p) > room THEN (p[len(p) - room + 1:] || c)[1:10] ELSE whole[1:10] END AS kept,
[CASE WHEN i <= len(p) THEN -100 ELSE whole[i] END FOR i IN range(1, least(9, len(whole)) + 1)] || [-100 FOR i IN range(least(9, len(whole)), 12)] AS labels FROM y""")
def completion_labels(spark, sf):
    none = F.array().cast("array<bigint>")
    ids = lambda first, n: F.when(n > 0, F.sequence(F.lit(first).cast("long"), F.lit(first) + n - 1)).otherwise(none)
    e = views.read(spark, sf, "embeddings").select("vec_id", ids(0, F.col("vec_id") % 13).alias("p"), ids(100, F.col("vec_id") % 12).alias("c"))
    labels = losses.masked_labels(F.concat("p", "c"), F.size("p"), 9, 12).cast("array<bigint>")
    return e.select("vec_id", losses.kept_completion(F.col("p"), F.col("c"), 10).alias("kept"), labels.alias("labels"))


# --- filters and checks --------------------------------------------------------------------------------------------

_TEACHER = "CASE candidate_role WHEN 'en' THEN 'Moonshot-KIMI' WHEN 'de' THEN 'kimi-k2' WHEN 'fr' THEN 'other' END"


@query(f"""WITH {H}, {_T}, x AS (SELECT *, {_TEACHER} AS teacher FROM tt)
SELECT 'with_verdict' AS method, candidate_role, count(*) AS n FROM x WHERE verdict IS NOT NULL GROUP BY 2 UNION ALL SELECT 'false_positives', candidate_role, count(*) FROM x WHERE verdict = 'Yes' AND NOT gold GROUP BY 2
UNION ALL SELECT 'false_negatives', candidate_role, count(*) FROM x WHERE verdict = 'No' AND gold GROUP BY 2 UNION ALL SELECT 'wrong_only', candidate_role, count(*) FROM x WHERE NOT gold GROUP BY 2
UNION ALL SELECT 'by_teacher', candidate_role, count(*) FROM x WHERE contains(lower(teacher), 'kimi') GROUP BY 2""")
def verdict_filters(spark, sf):
    r = F.col("candidate_role")
    teacher = F.when(r == "en", "Moonshot-KIMI").when(r == "de", "kimi-k2").when(r == "fr", "other")
    j = quality.judged(views.teacher(spark, sf)).withColumn("teacher_model", teacher)
    by_role = lambda df: metrics.value_counts(df, "candidate_role")
    return metrics.stacked(
        with_verdict=by_role(quality.with_verdict(j)), false_positives=by_role(quality.false_positives(j)), false_negatives=by_role(quality.false_negatives(j)),
        wrong_only=by_role(quality.wrong_only(j)), by_teacher=by_role(quality.by_teacher(j)),
    )


def _checked(spark, sf) -> DataFrame:
    """A nested sample for each conversation, with faults by its number."""
    c = F.col("conv_id")
    nan = float("nan")
    index = lambda i: F.when(c % 10 == 1, 0).when(c % 8 == 0, i + 1).otherwise(i).cast("int")
    token = lambda i: F.struct(index(i).alias("token_index"), F.when(i == c % 6, nan).otherwise(-0.5).alias("logprob"), F.lit(0.1).alias("entropy"))
    tokens = F.when(c % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), c % 5 - 1), token)).otherwise(F.array().cast(f"array<{schemas.TOKEN}>"))
    stats = [F.when(c % 4 == 2, nan).otherwise(0.2).alias("mean_entropy"), *[F.lit(0.2).alias(f"{n}_entropy") for n in ("max", "min", "std")]]
    step = F.struct((c % 3 - 1).cast("int").alias("start_token"), (c % 7 - 1).cast("int").alias("end_token"), *stats)
    candidate = F.struct(
        F.when(c % 3 == 0, "").otherwise("r").alias("reasoning_text"), F.when(c % 6 < 4, "").otherwise("1").alias("predicted_answer_raw"), F.lit("").alias("predicted_answer_normalized"), tokens.alias("tokens"), F.array(step).alias("steps")
    )
    return views.read(spark, sf, "conversations").select("conv_id").distinct().select(
        F.when(c % 9 == 0, " ").otherwise(F.concat(F.lit("c"), c.cast("string"))).alias("sample_id"), F.when(c % 7 != 0, "d").alias("dataset"), F.when(c % 5 == 0, "  ").otherwise("q").alias("question"),
        F.when(c % 4 == 1, "").when(c % 4 != 0, "a").alias("answer_raw"), F.array(candidate).alias("candidates"),
    )


_FAULTS = (
    ("missing_fields", "error", "c % 9 = 0"), ("missing_fields", "error", "c % 7 = 0"), ("missing_fields", "warning", "c % 5 = 0"), ("missing_fields", "warning", "c % 4 = 0"), ("missing_fields", "warning", "c % 4 = 1"),
    ("empty_outputs", "warning", "c % 3 = 0"), ("empty_outputs", "warning", "c % 3 <> 0 AND c % 6 < 4"), ("nan_values", "warning", "c % 6 < n"),
    ("entropy_mismatch", "warning", "(c % 10 <> 1 AND c % 8 = 0 AND n > 0) OR (c % 10 = 1 AND n > 1)"), ("entropy_mismatch", "warning", "c % 10 = 1 AND n > 1"),
    ("nan_values", "warning", "n > 0 AND c % 4 = 2"), ("entropy_mismatch", "warning", "n = 0"), ("entropy_mismatch", "warning", "n > 0 AND (a < 0 OR b < 0)"), ("entropy_mismatch", "warning", "n > 0 AND b < a"),
    ("entropy_mismatch", "warning", "n > 0 AND b > n"), ("entropy_mismatch", "warning", "n > 0 AND a > n"),
)


@query(
    "WITH s AS (SELECT conv_id AS c, conv_id % 5 AS n, conv_id % 3 - 1 AS a, conv_id % 7 - 1 AS b, CASE WHEN conv_id % 9 = 0 THEN '<missing>' ELSE 'c' || conv_id END AS sid FROM (SELECT DISTINCT conv_id FROM conversations)), x AS ("
    + " UNION ALL ".join(f"SELECT sid, '{check}' AS \"check\", '{severity}' AS severity FROM s WHERE {fault}" for check, severity, fault in _FAULTS)
    + ') SELECT "check", severity, count(*) AS n, count(DISTINCT sid) AS n_samples FROM x GROUP BY ALL'
)
def check_findings(spark, sf):
    return quality.check_summary(quality.issues(_checked(spark, sf)))


# --- records, ids, labels, prompts -----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'row_' || lpad(o_custkey::VARCHAR, 6, '0') || '_' || substr(sha1('{"o_orderkey":' || o_orderkey || '}'), 1, 16) WHEN o_orderkey % 3 = 1 THEN 'id' || o_orderkey ELSE o_orderstatus END AS id,
'gsm:' || o_orderstatus || ':' || lpad(o_custkey::VARCHAR, 5, '0') AS sample, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'x' END AS first, o_orderstatus || '/' || o_custkey AS meta, try_cast(o_orderpriority[1] AS DOUBLE) AS number FROM orders""")
def record_ids(spark, sf):
    o = views.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    row_id, plain = F.when(k % 3 == 1, F.concat(F.lit("id"), k.cast("string"))).otherwise(F.when(k % 2 == 0, "")), F.when(k % 3 == 2, F.col("o_orderstatus")).otherwise("")
    aliased = o.select("*", F.when(k % 4 == 0, F.concat(F.lit("  "), "o_orderpriority")).otherwise(" ").alias("problem"), F.lit("x").alias("prompt"))
    meta = text.source_metadata(status=F.col("o_orderstatus"), key=F.col("o_custkey"))
    return aliased.select(
        "o_orderkey", text.stable_id([row_id, plain], F.col("o_custkey"), F.to_json(F.struct("o_orderkey"))).alias("id"), text.sample_key("gsm", F.col("o_orderstatus"), F.col("o_custkey")).alias("sample"),
        text.first_alias(aliased, ["question", "problem", "prompt"], stripped=True).alias("first"), F.concat_ws("/", meta["status"], meta["key"]).alias("meta"),
        text.json_safe(text.number_or_nan(F.substring("o_orderpriority", 1, 1))).alias("number"),
    )


_RECORDS = (
    '{"is_correct": true, "gold_verdict": "no"}', '{"metadata": {"gold_is_correct": 0}, "candidate_is_correct": 1}', '{"gold_verdict": "Yes"}', '{}', '{"candidate_is_correct": "", "is_correct": 1}',
    '{"metadata": {"parsed_final_verdict": "No", "gold_verdict": "yes"}}', '{"gold_is_correct": "no", "gold_verdict": "maybe"}', '{"metadata": {"is_correct": false, "candidate_is_correct": 2.5}}',
)
_PATHS = [f"$.{m}{k}" for k in verdicts.LABEL_KEYS for m in ("", "metadata.")]
_FIRST = "[json_extract(r, p) FOR p IN [" + ", ".join(map(literal, _PATHS)) + "] IF json_extract(r, p) IS NOT NULL][1]"
_TRUTH = "CASE json_type(x) WHEN 'BOOLEAN' THEN x::VARCHAR = 'true' WHEN 'VARCHAR' THEN x::VARCHAR <> '\"\"' ELSE x::DOUBLE <> 0 END"
_WORD_AT = ", ".join(f"CASE WHEN r->>'{p}' IN ('Yes', 'No') THEN r->>'{p}' END" for p in ("$.gold_verdict", "$.parsed_final_verdict", "$.metadata.gold_verdict", "$.metadata.parsed_final_verdict"))


@query(f"""WITH e AS (SELECT event_id, ([{', '.join(map(literal, _RECORDS))}])[event_id % {len(_RECORDS)} + 1] AS r FROM events), f AS (SELECT *, {_FIRST} AS x FROM e)
SELECT event_id, CASE WHEN x IS NOT NULL THEN {_TRUTH} ELSE lower(coalesce(r->>'$.gold_verdict', r->>'$.metadata.gold_verdict', '')) = 'yes' END AS label,
coalesce({_WORD_AT}, CASE WHEN x IS NULL THEN NULL WHEN {_TRUTH} THEN 'Yes' ELSE 'No' END) AS verdict FROM f""")
def record_labels(spark, sf):
    r = F.element_at(F.array(*[F.lit(x) for x in _RECORDS]), (F.col("event_id") % len(_RECORDS) + 1).cast("int"))
    return views.read(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", verdicts.bool_label(F.col("r")).alias("label"), verdicts.gold_verdict(F.col("r")).alias("verdict"))


@query(f"""SELECT conv_id, turn, '### User:' || chr(10) || text || chr(10) || chr(10) || '### Assistant:' || chr(10) AS plain, 'Be brief.' AS system, 'Solve: ' || text || '!' AS ask, round(turn / 7.0::DOUBLE, 3) AS share,
{literal('Question:')} || chr(10) || text || chr(10) || chr(10) || 'Candidate Solution:' || chr(10) || role || chr(10) || chr(10) || {literal(prompts.VERIFY)} AS request FROM conversations""")
def plain_prompts(spark, sf):
    c = views.read(spark, sf, "conversations")
    t = F.col("text")
    m = prompts.question_messages(t, "Be brief.", "Solve: {question}!")
    share = F.round(text.from_percent(F.concat((F.col("turn") / 7.0 * 100).cast("string"), F.lit("%"))), 3)
    return c.select("conv_id", "turn", prompts.plain_chat(t).alias("plain"), m[0]["content"].alias("system"), m[1]["content"].alias("ask"), share.alias("share"), prompts.verify_request(t, F.col("role")).alias("request"))


_ERROR = "trim(regexp_replace(nullif(regexp_extract(answer_text, '(?is)Earliest\\s+Error\\s*:\\s*(.+?)(?:\\n\\s*Verification:|\\z)', 1), ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {H}, {_T} SELECT 'ok' AS status, 'r1' AS run_id, row_id, question, candidate_role, candidate_solution, '' AS reference_solution, '' AS expected_answer, '' AS candidate_predicted_answer,
'm' AS teacher_model, 'Q: ' || question AS teacher_prompt, answer_text, verdict AS parsed_final_verdict, {_ERROR} AS earliest_error FROM tt""")
def teacher_rows(spark, sf):
    t = views.teacher(spark, sf)
    return quality.teacher_row(t, prompts.fill(t, "Q: {question}"), F.col("answer_text"), "m", "r1")


@query(f"""WITH x AS ({SQL['filter_cascade']}), {H} SELECT h.row_id AS id, 'teacher_generated' AS source, 'openmathinstruct' AS dataset, NULL::VARCHAR AS question_norm, question, candidate_role, candidate_solution,
'' AS expected_answer, '' AS candidate_predicted_answer, '' AS reference_solution, {_TRIM.format('answer_text')} AS verification_rationale, x.verdict AS final_verdict, x.gold AS is_correct, {_ERROR} AS earliest_error,
NULL::VARCHAR AS teacher_model, NULL::VARCHAR AS run_id, h.row_id AS raw_row_id FROM h JOIN x USING (row_id) WHERE reject_reason IS NULL""")
def clean_rows(spark, sf):
    return quality.clean_rows(quality.judged(views.teacher(spark, sf), min_chars=100))


_CHAT = literal("Question:\n") + " || question || " + literal("\n\nCandidate Solution:\n") + " || candidate_solution || " + literal(f"\n\n{prompts.CHAT_TASK}")
_LINE = literal(prompts.VERDICT_LINE)


@query(f"""WITH x AS ({SQL['filter_cascade']}), {H}, y AS (SELECT h.row_id AS id, x.verdict, candidate_role, {_CHAT} AS user_text, {_TRIM.format('answer_text')} AS r FROM h JOIN x USING (row_id) WHERE reject_reason IS NULL)
SELECT id, user_text, CASE WHEN contains(r, 'Verification: Is the answer correct') THEN r ELSE r || chr(10) || {_LINE} || verdict END AS assistant_text, candidate_role || ':' || verdict AS meta FROM y""")
def chat_training_rows(spark, sf):
    c = prompts.chat_rows(quality.clean_rows(quality.judged(views.teacher(spark, sf), min_chars=100)))
    return c.select("id", F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"), F.concat_ws(":", F.col("metadata")["candidate_role"], F.col("metadata")["final_verdict"]).alias("meta"))


_WIDE = "０１２３４５６７８９"


@query(f"SELECT p_partkey, translate(p_size::VARCHAR, '0123456789', '{_WIDE}') || '.00' AS raw, p_size::VARCHAR AS normalized, p_size::VARCHAR AS gold FROM part")
def candidate_answers(spark, sf):
    """Answers in full-width digits, folded by NFKC."""
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", _WIDE)
    p = views.read(spark, sf, "part").select("p_partkey", answers.candidate_answer(F.concat(F.lit("Work.\n#### "), wide, F.lit(".00 \n"))).alias("a"), answers.gold_form(F.concat(F.lit("Answer: "), wide)).alias("gold"))
    return p.select("p_partkey", "a.raw", "a.normalized", "gold")


# --- joins, strategies, packs ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, coalesce(min(l.quality) OVER (PARTITION BY d.lang, d.source, l.toxic), -1)::INT AS least, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, 'none') AS grade
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN (SELECT lang FROM documents WHERE doc_id < 3)""")
def composite_lookup(spark, sf):
    d, labels = views.read(spark, sf, "documents").select("doc_id", "lang", "source"), views.read(spark, sf, "labels")
    d = groups.restrict(d, d.where("doc_id < 3").select("lang").distinct(), "lang")
    everywhere = views.read(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    least = everywhere.groupBy("lang", "source", "toxic").agg(F.min("quality").alias("least"))
    keyed = d.join(labels, "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    out = groups.lookup(keyed.drop("quality"), least.withColumn("toxic", F.coalesce("toxic", F.lit(-1))).withColumn("least", F.col("least").cast("string")), ["lang", "source", "toxic"], "least", "-1")
    grade = labels.where("quality = 1").select("doc_id", F.lit("good").alias("grade"))
    return groups.lookup(out, grade, ["doc_id"], "grade", "none").select("doc_id", F.col("least").cast("int").alias("least"), "grade")


@query(f"""WITH {C}, v AS (SELECT q, ans, count(*) AS n, min(pos) AS f, count(*) FILTER (yes) AS y_n, min(pos) FILTER (yes) AS y_f FROM c GROUP BY q, ans), s AS (SELECT *, max(y_n > 0) OVER (PARTITION BY q) AS any_yes FROM v),
p AS (SELECT *, CASE WHEN any_yes THEN y_n ELSE n END AS pn, CASE WHEN any_yes THEN y_f ELSE f END AS pf FROM s) SELECT q, arg_max(ans, {{'p': pn, 'f': -pf}}) AS answer, max(pn) AS votes FROM p WHERE pn > 0 GROUP BY q""")
def filtered_majority_plain(spark, sf):
    return select.STRATEGIES["filtered_majority_plain"](views.candidates(spark, sf), F.col("yes")).select("q", "answer", "votes")


@query("SELECT s AS strategy, (SELECT count(DISTINCT user_id) FROM events) AS n FROM (SELECT unnest(['majority', 'naive', 'filtered_majority', 'filtered_majority_plain', 'guarded_majority', 'support_filtered']) AS s)")
def all_strategies(spark, sf):
    """Every strategy answers every question once."""
    c = views.candidates(spark, sf)
    counted = [f(c, F.col("yes")).agg(F.lit(name).alias("strategy"), F.count_distinct("q").alias("n")) for name, f in select.STRATEGIES.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT (SELECT count(*) - 100 FROM events)")
def all_but_last(spark, sf):
    return select.all_but_last(views.read(spark, sf, "events").select("ts", "event_id"), 100, [F.col("ts"), F.col("event_id")]).select("event_id")


@query("""WITH x AS (SELECT p_brand AS q, p_partkey AS pos, list_distinct(string_split_regex(lower(p_name || ' ' || p_type || ' a b c'), '\\s+')) AS w, p_size % 3 = 0 AS ok FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS i FROM x WHERE ok QUALIFY i <= 2), f AS (SELECT q, w AS first FROM r WHERE i = 1),
s AS (SELECT x.q, pos, len(list_intersect(w, first)) * 200.0::DOUBLE / (len(w) + len(first)) AS sim FROM x JOIN f USING (q) WHERE NOT ok), o AS (SELECT *, sim BETWEEN 60 AND 98 AS near, row_number() OVER (PARTITION BY q ORDER BY (sim BETWEEN 60 AND 98) DESC, sim DESC, pos) AS i FROM s QUALIFY i <= 2)
SELECT q, pos, 'correct_' || i AS candidate_role, NULL::DOUBLE AS similarity FROM r UNION ALL SELECT q, pos, CASE WHEN i = 1 AND near THEN 'subtle_wrong' ELSE 'random_wrong' END, round(sim, 6) FROM o""")
def wrong_right_packs(spark, sf):
    p = views.read(spark, sf, "part").select(F.col("p_brand").alias("q"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" a b c")).alias("text"), (F.col("p_size") % 3 == 0).alias("ok"))
    return rounded(groups.packs(p.where("not ok"), p.where("ok")))


# --- sources, sinks, runs ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN n_chars / 2.0::DOUBLE END AS half FROM documents")
def jsonl_round_trip(spark, sf):
    """Written in two goes, NaN as null, and read again."""
    path = scratch(spark, "docs.jsonl")
    half = F.when(F.col("doc_id") % 5 == 0, float("nan")).otherwise(F.col("n_chars") / 2.0)
    d = views.read(spark, sf, "documents").select("doc_id", "lang", half.alias("half"))
    tables.write_jsonl(d.where("doc_id % 2 = 0"), path)
    tables.write_jsonl(d.where("doc_id % 2 = 1"), path, append=True)
    return tables.read_jsonl(spark, path, "doc_id long, lang string, half double")


@query("SELECT DISTINCT 'c' || c_custkey AS sample_id FROM customer WHERE c_custkey % 4 <> 3")
def ledger_ids(spark, sf):
    """A ledger with torn lines, ids that are no text, and blank lines."""
    path = scratch(spark, "ledger.jsonl")
    k = F.col("c_custkey")
    kind = F.when(k % 12 == 3, '{"sample_id": 5}').when(k % 12 == 7, '{"sample_id": "torn').when(k % 4 == 3, "").otherwise(F.concat(F.lit('{"x": 1, "sample_id": "c'), k.cast("string"), F.lit('"}')))
    views.read(spark, sf, "customer").select(kind.alias("value")).write.text(path)
    return tables.completed_ids(spark, path)


@query("SELECT s AS suffix, count(*) AS n, sum(length(n_name))::BIGINT AS letters FROM nation, (SELECT unnest(['csv', 'json', 'jsonl', 'parquet', 'orc']) AS s) GROUP BY s")
def table_readers(spark, sf):
    base = scratch(spark, "readers")
    n = views.read(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("")).alias("n_name"))
    tables.write_csv(n, f"{base}/t.csv")
    tables.write_jsonl(n, f"{base}/t.jsonl")
    n.write.parquet(f"{base}/t.parquet")
    n.write.orc(f"{base}/t.orc")
    n.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))), ","), F.lit("]"))).coalesce(1).write.text(f"{base}/t.json")
    out = None
    for suffix in ("csv", "json", "jsonl", "parquet", "orc"):
        one = tables.read_table(spark, f"{base}/t.{suffix}").agg(F.lit(suffix).alias("suffix"), F.count(F.lit(1)).alias("n"), F.sum(F.length("n_name")).alias("letters"))
        out = one if out is None else out.unionByName(one)
    return out


def _nested(spark, sf) -> DataFrame:
    """A sample for each conversation, its turns as candidates with word tokens."""
    c = views.read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    found = generate.with_steps(generate.with_entropy(generate.candidate_list(F.transform("m", lambda x: x["text"])), "per_word_uniform"))
    return c.select(
        F.lit("conv").alias("dataset"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sample_id"), F.lit("q").alias("question"), F.lit("a").alias("answer_raw"), F.lit("a").alias("answer_normalized"),
        F.lit(None).cast("string").alias("split"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), found.alias("candidates"),
    )


_WORDS = f"len([x FOR x IN string_split_regex(trim(text, {_WS}), '\\s+') IF x <> ''])"


@query(f"""SELECT 'cleaned_samples' AS name, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'candidate_paths', count(*) FROM conversations
UNION ALL SELECT 'entropy_features', sum({_WORDS})::BIGINT FROM conversations UNION ALL SELECT 'step1_dataset', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'nested_tokens', sum({_WORDS})::BIGINT FROM conversations""")
def sample_tables(spark, sf):
    """The four tables of nested samples, written and read again."""
    base = scratch(spark, "step1")
    tables.export(_nested(spark, sf), base)
    kinds = {"cleaned_samples": schemas.CLEANED, "candidate_paths": schemas.PATH, "entropy_features": schemas.ENTROPY, "step1_dataset": schemas.SAMPLE}
    parts = {n: tables.read_jsonl(spark, f"{base}/{n}.jsonl", s).agg(F.count(F.lit(1)).alias("n")) for n, s in kinds.items()}
    whole = tables.read_samples(spark, f"{base}/step1_dataset.jsonl").select(F.explode("candidates").alias("c")).agg(F.sum(F.size("c.tokens")).cast("long").alias("n"))
    return metrics.stacked(**parts, nested_tokens=whole).withColumnRenamed("method", "name")


@query("""SELECT 'gsm8k' AS dataset, 'gsm8k:train:' || lpad(doc_id::VARCHAR, 5, '0') AS sample_id, doc_id::VARCHAR AS place, 0 AS ordinal, 'train' AS split FROM documents
UNION ALL SELECT 'math500', 'math500:' || p_partkey, p_brand, 1, 'test' FROM part""")
def source_union(spark, sf):
    d, p = views.read(spark, sf, "documents"), views.read(spark, sf, "part")
    a = tables.gsm8k(d.select(F.col("text").alias("question"), F.col("lang").alias("answer"), F.col("doc_id").alias("row")), "train")
    b = tables.math500(p.select(F.col("p_name").alias("problem"), F.col("p_type").alias("solution"), F.col("p_size").cast("string").alias("answer"), F.col("p_partkey").cast("string").alias("unique_id"), F.col("p_brand").alias("subject"), F.lit(3).alias("level")))
    place = F.coalesce(F.try_element_at("metadata", F.lit("hf_row_index")), F.try_element_at("metadata", F.lit("subject")))
    return tables.all_sources(a, b).select("dataset", "sample_id", place.alias("place"), "ordinal", "split")


@query("SELECT 'k=3' AS args, count(*) AS n_rows, count(DISTINCT event_type) AS n_types FROM events")
def run_report(spark, sf):
    """Counters and arguments of a run, written as its manifest and read again."""
    path = scratch(spark, "report.json")
    row = views.read(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_type").alias("n_types")).first()
    made = tables.manifest(row.asDict(), tables.GenerationConfig(k=3))
    config = tables.nested_get(made, "args.k")
    tables.write_report(spark.createDataFrame([(f"k={config}", made["n_rows"], made["n_types"], float("nan"))], "args string, n_rows long, n_types long, rate double"), path)
    return spark.read.schema("args string, n_rows long, n_types long, rate double").json(path).where("rate is null").drop("rate")


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN 'dead' ELSE 'ok' END AS part, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def failure_split(spark, sf):
    ok, dead = tables.split_failures(views.teacher(spark, sf))
    return metrics.stacked(ok=ok.agg(F.count(F.lit(1)).alias("n")), dead=dead.agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("method", "part")


@query("""WITH k AS (SELECT DISTINCT user_id AS q FROM events), o AS (SELECT q, row_number() OVER (ORDER BY md5('42:' || q), q) - 1 AS i, count(*) OVER () AS n FROM k),
s AS (SELECT q, CASE WHEN i < n - ceil(n * 0.4) THEN 'train' WHEN i < n - ceil(ceil(n * 0.4) * 0.5) THEN 'valid' ELSE 'test' END AS split FROM o) SELECT split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events JOIN s ON user_id = q GROUP BY split""")
def split_files(spark, sf):
    """A folder of JSON lines for each split."""
    path = scratch(spark, "splits")
    e = views.read(spark, sf, "events").select(F.col("user_id").alias("q"), "event_id")
    tables.write_jsonl(groups.group_split(e, "q"), path, by=["split"])
    return spark.read.schema("q long, event_id long, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT 'p' || p_partkey AS sample_id, i AS candidate_index, i::VARCHAR AS answer, (len(string_split_regex('Step 1: ' || p_name, '\\s+')) + len(string_split_regex('Step 2: #### ' || i, '\\s+')))::INT AS n_tokens, 2 AS n_steps FROM part, (SELECT unnest([0, 1, 2]) AS i)""")
def step_one_run(spark, sf):
    """The whole first step, twice: the second run finds everything in the ledger. Candidates come from a callable."""
    base = scratch(spark, "run")
    p = views.read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    samples = p.select(
        F.lit("part").alias("dataset"), F.concat(F.lit("p"), key).alias("sample_id"), F.col("p_name").alias("question"), F.concat(F.lit("#### "), key).alias("answer_raw"), F.lit("").alias("answer_normalized"),
        F.lit("train").alias("split"), F.create_map(F.lit("k"), key).alias("metadata"),
    )
    config = tables.GenerationConfig(k=3)
    for _ in range(2):
        generate.run_step_one(spark, samples, base, lambda q, i: f"Step 1: {q}\nStep 2: #### {i}", config, "per_word_uniform")
    done = resume.side_table(spark, base, "step1_dataset").select("sample_id", F.posexplode("candidates").alias("candidate_index", "c"))
    return done.select("sample_id", "candidate_index", F.col("c.predicted_answer_normalized").alias("answer"), F.size("c.tokens").alias("n_tokens"), F.size("c.steps").alias("n_steps"))
