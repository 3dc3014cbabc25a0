"""Queries over the driver's tables, one for each family of operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, entropy, prompts, text, verdicts
from ..operators import groups, losses, metrics, quality, segment, select
from ..streaming import resume
from . import views
from .views import C, D, H, P, R, T, literal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    """Doubles to six decimals, as in the SQL."""
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- selection ---------------------------------------------------------------------------------------------------

_VOTES = "v AS (SELECT q, ans, count(*) AS n, min(pos) AS f, count(*) FILTER (yes) AS y_n, min(pos) FILTER (yes) AS y_f FROM c GROUP BY q, ans)"


@query(f"WITH {C}, {_VOTES}, m AS (SELECT *, max(n) OVER (PARTITION BY q) AS top FROM v) SELECT q, arg_max(ans, {{'n': n, 'f': -f}}) AS answer, max(n) AS votes, count(*) FILTER (n = top)::INT AS n_tied FROM m GROUP BY q")
def vote_majority(spark, sf):
    return select.majority(views.candidates(spark, sf))


@query(f"""WITH {C}, x AS (SELECT q, pos, ans, CASE WHEN pos % 4 = 0 AND q % 5 <> 0 THEN -score END AS lp, CASE WHEN pos % 7 <> 0 THEN score END AS en FROM c),
y AS (SELECT q, arg_max(ans, CASE WHEN lp IS NOT NULL THEN {{'l': lp, 'p': -pos}} END) AS b, arg_min(ans, {{'k': en IS NOT NULL, 'e': coalesce(en, 0.0), 'p': pos}}) AS c2, count(lp) AS k FROM x GROUP BY q)
SELECT q, CASE WHEN k > 0 THEN b ELSE c2 END AS answer FROM y""")
def vote_confidence(spark, sf):
    c = views.candidates(spark, sf)
    c = c.withColumn("logprob", F.when((F.col("pos") % 4 == 0) & (F.col("q") % 5 != 0), -F.col("score"))).withColumn("entropy", F.when(F.col("pos") % 7 != 0, F.col("score")))
    return select.by_confidence(c)


@query(f"""WITH {R}, u AS (SELECT q, run, len(list_distinct(list(role) FILTER (role IN ('RF', 'AF', 'NO')))) AS cover, min(pos) AS f, count(*) AS m FROM r GROUP BY q, run),
g AS (SELECT run, sum(m) AS freq FROM u GROUP BY run), b AS (SELECT q, arg_max(u.run, {{'c': coalesce(cover, 0), 'g': freq, 'f': -f}}) AS run FROM u JOIN g USING (run) GROUP BY q)
SELECT r.* FROM r SEMI JOIN b ON r.q = b.q AND r.run = b.run""")
def pick_best_run(spark, sf):
    return select.best_run(views.runs(spark, sf), ["RF", "AF", "NO"])


_WORDS = "[" + ", ".join(map(str, select.WORDS)) + "]"


def _draw(n: str, words: str = _WORDS) -> str:
    """The seeded place among n, in SQL: the leading bits, as many as n has, of the first word for which they are less than n."""
    lead = f"x // (1 << (32 - length(bin(({n})::BIGINT))))"
    return f"list_transform(list_filter({words}, lambda x: {lead} < ({n})), lambda x: {lead})[1]"


def _used(n: str) -> str:
    """How many words that takes."""
    return f"list_position(list_transform({_WORDS}, lambda x: x // (1 << (32 - length(bin(({n})::BIGINT)))) < ({n})), true)"


@query(f"""WITH {C}, p AS (SELECT *, max(yes) OVER (PARTITION BY q) AS any_yes FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY q) AS n, avg(ok::INT) OVER (PARTITION BY q) AS e FROM p WHERE yes OR NOT any_yes)
SELECT q, pos AS chosen_pos, ans, ok, round(e, 6) AS expected, CASE WHEN any_yes THEN 'yes_pool' ELSE 'all' END AS strategy FROM o WHERE i = {_draw('n')}""")
def teacher_naive(spark, sf):
    return rounded(select.pool_pick(views.candidates(spark, sf), F.col("yes")))


@query(f"""WITH {C}, {_VOTES}, s AS (SELECT *, max(y_n > 0) OVER (PARTITION BY q) AS any_yes FROM v), p AS (SELECT *, CASE WHEN any_yes THEN y_n ELSE n END AS pn, CASE WHEN any_yes THEN y_f ELSE f END AS pf FROM s)
SELECT q, arg_max(ans, {{'p': pn, 'n': n, 'f': -pf}}) AS answer, max(pn) AS votes, CASE WHEN bool_or(any_yes) THEN 'yes_pool' ELSE 'all' END AS strategy FROM p WHERE pn > 0 GROUP BY q""")
def filtered_majority(spark, sf):
    return select.filtered_majority(views.candidates(spark, sf), F.col("yes"))


def _guard(rows: str, base: str = "c") -> str:
    """The guarded majority over candidates `base`, in SQL."""
    after = f"list_slice({_WORDS}, ({_used('tied')} + 1)::INT, {len(select.WORDS)})"
    return f"""WITH {rows}, v AS (SELECT q, ans, count(*) AS n, min(pos) AS f, count(*) FILTER (yes) AS y_n, min(pos) FILTER (yes) AS y_f FROM {base} GROUP BY q, ans),
m AS (SELECT *, max(n) OVER (PARTITION BY q) AS g_max, max(y_n) OVER (PARTITION BY q) AS y_max FROM v),
t AS (SELECT q, any_value(g_max) AS g_max, any_value(y_max) AS y_max, list({{'f': f, 'a': ans, 'y': y_n}} ORDER BY f) FILTER (n = g_max) AS gt, coalesce(list({{'f': y_f, 'a': ans}} ORDER BY y_f) FILTER (y_n = y_max AND y_max > 0), []) AS yt FROM m GROUP BY q),
s AS (SELECT *, CASE WHEN y_max = 0 THEN 'B_no_yes_global' WHEN len(yt) = 1 AND len(gt) = 1 AND yt[1].a <> gt[1].a AND g_max >= 2 AND gt[1].y > 0 THEN 'B_conflict_guard_global' ELSE 'B_yes_majority' END AS strategy FROM t),
a AS (SELECT q, strategy, CASE WHEN strategy = 'B_yes_majority' THEN yt[({_draw('len(yt)')} + 1)::INT].a ELSE gt[({_draw('len(gt)')} + 1)::INT].a END AS answer, CASE strategy WHEN 'B_conflict_guard_global' THEN 0 WHEN 'B_yes_majority' THEN len(yt) ELSE len(gt) END AS tied FROM s),
x AS (SELECT d.q, d.pos, a.answer, a.strategy, a.tied, row_number() OVER (PARTITION BY d.q ORDER BY d.pos) - 1 AS i, count(*) OVER (PARTITION BY d.q) AS n FROM {base} d JOIN a ON d.q = a.q AND d.ans = a.answer WHERE a.strategy <> 'B_yes_majority' OR d.yes)
SELECT x.q, answer, pos AS chosen_pos, strategy, v.n AS global_votes, v.y_n AS yes_votes FROM x JOIN v ON v.q = x.q AND v.ans = x.answer WHERE i = CASE WHEN tied = 0 THEN {_draw('x.n')} ELSE {_draw('x.n', after)} END"""


_GUARD = _guard(C)


@query(_GUARD)
def guarded_majority(spark, sf):
    return select.guarded_majority(views.candidates(spark, sf), F.col("yes"))


@query(_guard(f"{C}, {D}", "d"))
def guarded_majority_daily(spark, sf):
    """Many questions of few candidates each, with ties."""
    return select.guarded_majority(views.daily(spark, sf), F.col("yes"))


@query(f"WITH g AS ({_GUARD}) SELECT strategy, count(*) AS n FROM g GROUP BY strategy")
def strategy_usage(spark, sf):
    return metrics.value_counts(guarded_majority(spark, sf), "strategy")


@query(f"""WITH {C}, v AS (SELECT q, ans, count(*) AS n, min(pos) AS f, max(score) FILTER (yes) AS m FROM c GROUP BY q, ans), w AS (SELECT *, m IS NOT NULL AND n >= 2 AS g FROM v)
SELECT q, arg_max(ans, {{'g': g, 's': CASE WHEN g THEN m ELSE n::DOUBLE END, 'n': n, 'f': -f}}) AS answer, CASE WHEN bool_or(g) THEN 'conf_support2' ELSE 'fallback_global_majority' END AS strategy FROM w GROUP BY q""")
def support_filtered(spark, sf):
    return select.support_filtered(views.candidates(spark, sf), F.col("yes"))


@query(f"WITH {C} SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY pos) <= 2")
def first_per_group(spark, sf):
    return select.first_rows(views.candidates(spark, sf), 2, [F.col("pos")], ["q"])


# --- groups and joins --------------------------------------------------------------------------------------------


@query(f"WITH {C}, {D} SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY q) = 4")
def complete_groups(spark, sf):
    return groups.complete(views.daily(spark, sf).drop("day"), "q", 4)


@query(f"WITH {C}, {D} SELECT * FROM d QUALIFY count(*) FILTER (ok) OVER (PARTITION BY q) >= 2 AND count(*) FILTER (NOT ok) OVER (PARTITION BY q) >= 2")
def groups_of_both_kinds(spark, sf):
    return groups.both_kinds(views.daily(spark, sf).drop("day"), "q", "ok")


@query(f"WITH {C}, {D}, s AS (SELECT q, count(*) AS size FROM d GROUP BY q) SELECT size, count(*) AS n_groups FROM s GROUP BY size")
def group_size_hist(spark, sf):
    return metrics.group_sizes(views.daily(spark, sf), "q")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending(spark, sf):
    done = views.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return groups.pending(views.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""WITH o AS (SELECT user_id AS c_custkey, arg_max(CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END, event_id) FILTER (event_type <> 'view') AS n FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(n, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN o USING (c_custkey)""")
def overlay_join(spark, sf):
    over = views.read(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("c_mktsegment"))
    return groups.overlay(views.read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), over, "c_custkey", "c_mktsegment", "event_id")


@query("SELECT conv_id, len(list(turn)) AS n, list({'turn': turn, 'role': role} ORDER BY turn)[1].role AS first_role, list({'turn': turn, 'role': role} ORDER BY turn)[-1].role AS last_role FROM conversations GROUP BY conv_id")
def nested_candidates(spark, sf):
    c = views.read(spark, sf, "conversations")
    n = groups.nested(c.select("conv_id").distinct(), c.select("conv_id", "turn", "role"), "conv_id", "turn")
    return n.select("conv_id", F.size("candidates").cast("long").alias("n"), F.element_at("candidates", 1)["role"].alias("first_role"), F.element_at("candidates", -1)["role"].alias("last_role"))


@query("SELECT doc_id, coalesce(quality::VARCHAR, '__MISS__') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def gold_lookup(spark, sf):
    return groups.lookup(views.read(spark, sf, "documents").select("doc_id"), views.read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), ["doc_id"], "quality", "__MISS__")


@query("SELECT user_id AS q FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 400")
def common_questions(spark, sf):
    e = views.read(spark, sf, "events").withColumnRenamed("user_id", "q")
    return groups.common_keys("q", e.where("event_type = 'view'"), e.where("event_type = 'error'"), e.where("value > 400"))


_SPLIT = """k AS (SELECT DISTINCT user_id AS q FROM events), o AS (SELECT q, row_number() OVER (ORDER BY md5('42:' || q), q) - 1 AS i, count(*) OVER () AS n FROM k),
s AS (SELECT q, CASE WHEN i < n - ceil(n * 0.4) THEN 'train' WHEN i < n - ceil(ceil(n * 0.4) * 0.5) THEN 'valid' ELSE 'test' END AS split FROM o)"""


@query(f"WITH {_SPLIT} SELECT * FROM s")
def group_split(spark, sf):
    return groups.group_split(views.read(spark, sf, "events").select(F.col("user_id").alias("q")).distinct(), "q")


@query(f"WITH {_SPLIT} SELECT q, count(DISTINCT split) AS n_splits FROM s GROUP BY q HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf):
    e = views.read(spark, sf, "events").select(F.col("user_id").alias("q"), "event_id")
    return groups.leaks(groups.group_split(e, "q"), "q")


@query(f"WITH {P}, b AS (SELECT role, min(n) AS m, count(*) AS k FROM (SELECT role, gold, count(*) AS n FROM p GROUP BY role, gold) GROUP BY role) SELECT doc_id, role, gold FROM p JOIN b USING (role) QUALIFY row_number() OVER (PARTITION BY role, gold ORDER BY md5('42:' || doc_id), doc_id) <= least(m, floor(100 / k))")
def source_balance(spark, sf):
    return groups.balanced(views.predictions(spark, sf), ["role"], "gold", most=100, key="doc_id").select("doc_id", "role", "gold")


@query("""WITH u AS (SELECT doc_id, text FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, text FROM documents WHERE lang <> 'en' AND ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < 1073741824)
SELECT doc_id FROM u QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def mixture(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", "text", "lang")
    return groups.mixture([(d.where("lang = 'en'"), 1.0), (d.where("lang <> 'en'"), 0.25)], ["text"], "doc_id").select("doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE trim(text, E' \\t\\n\\r') <> '' AND length(text) BETWEEN 20 AND 4096 GROUP BY text")
def pool_filter(spark, sf):
    d = views.read(spark, sf, "documents")
    kept = groups.pool_filter(d.select(F.lit(1).alias("q"), "text"), "text", "q")
    return d.join(kept.select("text"), "text").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


# --- metrics -----------------------------------------------------------------------------------------------------

_F1 = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1"


def _prf(by: str, pred: str = "pred_a") -> str:
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    names = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
    return f"""WITH {P}, k AS (SELECT {head}count(*) FILTER ({pred} AND gold) AS tp, count(*) FILTER ({pred} AND NOT gold) AS fp, count(*) FILTER (NOT {pred} AND gold) AS fn, count(*) FILTER (NOT {pred} AND NOT gold) AS tn, count(*) AS n FROM p {tail}),
    s AS (SELECT *, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, {_F1} FROM k) SELECT {head}tp, fp, fn, tn, n, accuracy, {names} FROM s"""


@query(_prf(""))
def classification(spark, sf):
    return rounded(metrics.classification(views.predictions(spark, sf), F.col("pred_a"), F.col("gold")))


@query(_prf("role"))
def per_role(spark, sf):
    return rounded(metrics.classification(views.predictions(spark, sf), F.col("pred_a"), F.col("gold"), ["role"]))


@query(f"WITH {P}, k AS (SELECT role, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1 FROM p GROUP BY role) SELECT *, round(n_0 * 100.0 / (n_0 + n_1)::DOUBLE, 6)::DOUBLE AS pct_0, round(n_1 * 100.0 / (n_0 + n_1)::DOUBLE, 6)::DOUBLE AS pct_1 FROM k")
def crosstab(spark, sf):
    return rounded(metrics.crosstab(views.predictions(spark, sf), "role", "toxic", [0, 1]))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return metrics.value_counts(views.read(spark, sf, "events"), "event_type")


@query(f"""WITH {C}, k AS (SELECT q, bool_or(ok) AS any_ok, bool_or(ok AND pos % 37 = 0) AS first_ok, avg(ok::INT) AS p FROM c GROUP BY q)
SELECT count(*) AS n_questions, round(avg(any_ok::INT), 6) AS oracle, round(avg(first_ok::INT), 6) AS pass_at_1, round(avg(p), 6) AS random_mean, round(sqrt(sum(p * (1 - p))) / count(*), 6) AS random_std FROM k""")
def oracle_and_random(spark, sf):
    """The index of a candidate is made up; some questions have none of index 0."""
    return rounded(metrics.oracle_any(views.candidates(spark, sf).withColumn("idx", F.col("pos") % 37)))


_VERDICT_T = "nullif(regexp_extract(answer_text, '(?i)Is\\s+the\\s+answer\\s+correct\\s*\\(Yes/No\\)\\?\\s*(Yes|No)', 1), ''), nullif(regexp_extract(answer_text, '(?i)Final\\s+Verdict\\s*:\\s*(Yes|No)', 1), ''), nullif(regexp_extract(answer_text, '(?i)Final\\s+Answer\\s*:\\s*(Yes|No)', 1), '')"
_CAP = "upper({0}[1]) || lower({0}[2:])"
_T = f"tv AS (SELECT *, coalesce({_VERDICT_T}) AS tv0 FROM h), tt AS (SELECT *, {_CAP.format('tv0')} AS verdict FROM tv)"


@query(f"WITH {H}, {_T} SELECT count(*) AS n, round(count(verdict) / count(*)::DOUBLE, 6) AS parse_rate, round(count(*) FILTER (regexp_matches(answer_text, '(?i)Verification:\\s*Is the answer correct')) / count(*)::DOUBLE, 6) AS format_rate, round(count(*) FILTER (coalesce((verdict = 'Yes') = gold, false)) / count(*)::DOUBLE, 6) AS strict_accuracy, round(count(*) FILTER ((verdict = 'Yes') = gold) / count(verdict)::DOUBLE, 6) AS parsed_accuracy FROM tt")
def parse_metrics(spark, sf):
    t = views.teacher(spark, sf)
    pred = verdicts.verdict_to_bool(verdicts.teacher_verdict(F.col("answer_text")))
    return rounded(metrics.parse_metrics(t, pred, text.bool_from_any(F.col("candidate_is_correct")), verdicts.has_format(F.col("answer_text"))))


@query(f"""WITH {P}, g AS (SELECT (i * 100)::DOUBLE AS threshold FROM range(0, 60) x(i)),
k AS (SELECT threshold, count(*) FILTER (score >= threshold AND gold) AS tp, count(*) FILTER (score >= threshold AND NOT gold) AS fp, count(*) FILTER (score < threshold AND gold) AS fn, count(*) FILTER (score >= threshold) AS n_yes FROM g, p GROUP BY threshold),
s AS (SELECT threshold, n_yes, {_F1} FROM k) SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n_yes FROM s""")
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(views.predictions(spark, sf), "score", F.col("gold"), [100.0 * i for i in range(60)]))


_NAMES = verdicts.TRANSITIONS


@query(f"WITH {P}, t AS (SELECT CASE WHEN pred_a = gold AND pred_b = gold THEN {literal(_NAMES[True, True])} WHEN pred_a = gold THEN {literal(_NAMES[True, False])} WHEN pred_b = gold THEN {literal(_NAMES[False, True])} ELSE {literal(_NAMES[False, False])} END AS transition FROM p), k AS (SELECT transition, count(*) AS n FROM t GROUP BY transition) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM k")
def transition(spark, sf):
    p = views.predictions(spark, sf)
    pair = groups.paired(p.withColumn("right", F.col("pred_a") == F.col("gold")), p.withColumn("right", F.col("pred_b") == F.col("gold")), ["doc_id", "role", "gold"], "right")
    return rounded(metrics.transitions(pair.select(verdicts.transition(F.col("right_a"), F.col("right_b")).alias("transition"))))


@query(f"""WITH {P}, v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, (pred_b = gold)::INT - (pred_a = gold)::INT AS d, count(*) OVER () AS n FROM p), z AS (SELECT max(n) AS n FROM v),
w AS (SELECT id // n AS b, ((1103515245 * (id + 1) + 12345) % 2147483648) % n AS i FROM z, range(0, 200 * (SELECT n FROM z)) x(id)),
m AS (SELECT b, sum(d) / max(n)::DOUBLE AS mean FROM w JOIN v USING (i) GROUP BY b)
SELECT round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025::DOUBLE), 6) AS ci_low, round(quantile_cont(mean, 0.975::DOUBLE), 6) AS ci_high, round(avg((mean <= 0)::INT), 6) AS p_le_0 FROM m""")
def bootstrap_ci(spark, sf):
    p = views.predictions(spark, sf)
    d = p.select("doc_id", ((F.col("pred_b") == F.col("gold")).cast("int") - (F.col("pred_a") == F.col("gold")).cast("int")).alias("d"))
    return rounded(metrics.interval(metrics.bootstrap(groups.row_numbers(d, "doc_id", "i").select("d", "i"), "d", 200)))


@query(f"WITH {C} SELECT ans, count(*) AS verifier_calls, count(DISTINCT q) AS n_questions, round(count(*) / count(DISTINCT q)::DOUBLE, 6) AS calls_per_q FROM c GROUP BY ans")
def efficiency(spark, sf):
    return rounded(metrics.efficiency(views.candidates(spark, sf), "ans"))


@query(f"WITH {P} SELECT 'A' AS method, round(avg((pred_a = gold)::INT), 6) AS accuracy, count(*) AS n FROM p UNION ALL SELECT 'B', round(avg((pred_b = gold)::INT), 6), count(*) FROM p")
def same_split_table(spark, sf):
    p = views.predictions(spark, sf)
    one = lambda c: p.agg(r6(F.avg((F.col(c) == F.col("gold")).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return metrics.stacked(A=one("pred_a"), B=one("pred_b"))


# --- text, verdicts, answers ---------------------------------------------------------------------------------------

_TRIM = "trim({0}, E' \\t\\n\\r')"


@query(f"""WITH {H}, {_T}, ee AS (SELECT *, nullif(regexp_extract(answer_text, '(?is)Earliest\\s+Error\\s*:\\s*(.+?)(?:\\n\\s*Verification:|\\z)', 1), '') AS e0,
[lower(x) FOR x IN regexp_extract_all(answer_text, '(?i)\\b(yes|no)\\b')] AS yn,
coalesce(nullif(regexp_extract(answer_text, '(?i)Is the answer correct\\s*\\(Yes/No\\)\\?\\s*(Yes|No)', 1), ''), nullif(regexp_extract(answer_text, '(?i)Final\\s*(?:Answer|Grade|Verdict)?\\s*[:\\-]?\\s*(Yes|No)', 1), '')) AS v1,
nullif(lower(regexp_extract(answer_text, '(?i)<final_verdict>\\s*(yes|no)\\s*</final_verdict>', 1)), '') AS tag FROM tt), e2 AS (SELECT *, coalesce(v1, yn[-1]) AS v2, trim(regexp_replace(e0, '\\s+', ' ', 'g')) AS error FROM ee)
SELECT row_id, verdict AS teacher, {_CAP.format('v2')} AS evaluation, CASE WHEN tag IS NOT NULL THEN {_CAP.format('tag')} WHEN list_contains(yn, 'yes') THEN 'Yes' WHEN list_contains(yn, 'no') THEN 'No' END AS notebook, error,
CASE WHEN error IS NULL THEN 'No error' WHEN error ILIKE '%arithmetic%' THEN 'Arithmetic error' ELSE 'Other' END AS error_class FROM e2""")
def verdict_parse(spark, sf):
    a = F.col("answer_text")
    error = verdicts.earliest_error(a)
    return views.teacher(spark, sf).select("row_id", verdicts.teacher_verdict(a).alias("teacher"), verdicts.evaluation_verdict(a).alias("evaluation"), verdicts.tag_verdict(a).alias("notebook"), error.alias("error"), verdicts.error_class(error).alias("error_class"))


@query(f"""WITH {H}, {_T} SELECT row_id, verdict, gold, CASE WHEN status <> 'ok' THEN 'status_not_ok' WHEN length({_TRIM.format('answer_text')}) < 100 THEN 'rationale_too_short' WHEN verdict IS NULL THEN 'missing_or_invalid_final_verdict' WHEN (verdict = 'Yes') <> gold THEN 'verdict_label_mismatch' END AS reject_reason FROM tt""")
def filter_cascade(spark, sf):
    return quality.judged(views.teacher(spark, sf), min_chars=100).select("row_id", "verdict", "gold", "reject_reason")


@query(f"WITH x AS ({SQL['filter_cascade']}) SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n FROM x GROUP BY reason")
def reject_counts(spark, sf):
    return quality.reject_counts(quality.judged(views.teacher(spark, sf), min_chars=100))


@query(f"""WITH x AS ({SQL['filter_cascade']}), {H} SELECT h.row_id AS id, 'teacher_generated' AS source, 'openmathinstruct' AS dataset, question, candidate_role, candidate_solution, {_TRIM.format('answer_text')} AS verification_rationale, x.verdict AS final_verdict, x.gold AS is_correct FROM h JOIN x USING (row_id) WHERE reject_reason IS NULL""")
def clean_projection(spark, sf):
    names = ["id", "source", "dataset", "question", "candidate_role", "candidate_solution", "verification_rationale", "final_verdict", "is_correct"]
    return quality.clean_rows(quality.judged(views.teacher(spark, sf), min_chars=100)).select(*names)


@query(f"""WITH {H}, x AS (SELECT row_id, {_TRIM.format('answer_text')} AS raw FROM h) SELECT row_id, CASE WHEN contains(raw, '####') THEN {_TRIM.format("split_part(raw, '####', -1)")} WHEN contains(raw, '\\boxed') THEN '\\frac{{1}}{{2}}' ELSE {_TRIM.format("[l FOR l IN string_split(raw, chr(10)) IF " + _TRIM.format('l') + " <> ''][-1]")} END AS answer FROM x""")
def answer_extract(spark, sf):
    return views.teacher(spark, sf).select("row_id", answers.final_answer(F.col("answer_text")).alias("answer"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN '$' || l_extendedprice::DECIMAL(18,2) || '.' WHEN 1 THEN ' ' || l_quantity::BIGINT || '.00 ' WHEN 2 THEN 'Abc, ' || l_returnflag ELSE l_discount::DECIMAL(18,2)::VARCHAR END AS a FROM lineitem), y AS (SELECT *, regexp_replace(trim(regexp_replace(trim(a), '[$,]', '', 'g')), '\\.+$', '') AS t FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN try_cast(t AS DOUBLE) IS NULL THEN t WHEN abs(t::DOUBLE - round(t::DOUBLE)) < 1e-9 THEN round(t::DOUBLE)::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.6f', t::DOUBLE), '0+$', ''), '\\.$', '') END AS form FROM y""")
def answer_norm_score(spark, sf):
    i = views.read(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 4
    a = F.when(n == 0, F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."))).when(n == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"), F.lit(".00 "))).when(n == 2, F.concat(F.lit("Abc, "), F.col("l_returnflag"))).otherwise(F.col("l_discount").cast("decimal(18,2)").cast("string"))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", answers.score_form(a).alias("form"))


@query("""WITH x AS (SELECT doc_id, string_split_regex(trim(lower(regexp_replace(text, '[$,\\\\]', '', 'g')), E' \\t\\n\\r'), '\\s+') AS w, trim(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '[$,\\\\]', '', 'g'), E' \\t\\n\\r') AS t FROM documents),
y AS (SELECT *, [v FOR v IN [trim(u, '.,!?;:()') FOR u IN w] IF regexp_full_match(regexp_replace(v, '[./-]', '', 'g'), '[0-9]+')] AS k FROM x)
SELECT doc_id, CASE WHEN len(w) > 10 THEN coalesce(k[-1], w[-1]) ELSE t END AS form FROM y""")
def answer_norm_light(spark, sf):
    return views.texts(spark, sf, "doc_id", "text").select("doc_id", answers.light_form(F.col("text")).alias("form"))


@query("SELECT p_partkey, p_size || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.00' END AS form FROM part")
def answer_norm_gold(spark, sf):
    a = F.concat(F.lit("The final answer is: $"), F.col("p_size").cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.when(F.col("p_partkey") % 2 == 0, ".00$").otherwise(".00$."))
    return views.read(spark, sf, "part").select("p_partkey", answers.gold_form(a, compatibility=False).alias("form"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\r\\f]+(\\n|$)', '\\1', 'g'), E' \\t\\n\\r') AS clean, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS question_norm FROM documents")
def clean_text(spark, sf):
    return views.texts(spark, sf, "doc_id", "text").select("doc_id", text.clean_whitespace(F.col("text")).alias("clean"), text.question_key(F.col("text")).alias("question_norm"))


@query("""WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?[.!?]+(?:\\s+|\\z)|(?s).+\\z') AS p FROM documents), y AS (SELECT doc_id, text, [s FOR s IN p IF trim(s, E' \\t\\n\\r') <> ''] AS k FROM x)
SELECT doc_id, len(k)::BIGINT AS n_spans, length(k[1])::BIGINT AS first_end, (length(text) - length(k[-1]))::BIGINT AS last_start FROM y WHERE len(k) > 0""")
def segment_sentences(spark, sf):
    # only an empty text has no span; a condition on the spans would have them made twice
    d = views.texts(spark, sf, "doc_id", "text").where("text <> ''").select("doc_id", segment.reasoning_spans(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.element_at("s", 1)["e"].cast("long").alias("first_end"), F.element_at("s", -1)["s"].cast("long").alias("last_start"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body, 'S' || max(CASE WHEN turn = 0 AND role = 'system' THEN 'own' ELSE 'default' END) AS head FROM conversations GROUP BY conv_id")
def chat_render(spark, sf):
    c = views.read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    m = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    default = F.lit(f"<|im_start|>system\n{prompts.DEFAULT_SYSTEM}<|im_end|>\n")
    out = c.select("conv_id", prompts.chat(m).alias("t"))
    own = ~F.col("t").startswith(default)
    return out.select("conv_id", F.when(own, F.col("t")).otherwise(F.substr("t", F.length(default) + 1)).alias("body"), F.when(own, "Sown").otherwise("Sdefault").alias("head"))


_SFT_TEXT = literal(prompts.SFT_HEAD + "Question:\n") + " || question || " + literal("\n\nCandidate reasoning:\n") + " || substr(candidate_solution, 1, 3000) || " + literal("\n\nCandidate final answer: None\n\n" + prompts.SFT_TASK)


@query(f"""WITH {H} SELECT row_id, {_SFT_TEXT} AS prompt, '<final_verdict>' || CASE WHEN gold THEN 'Yes' ELSE 'No' END || '</final_verdict>' AS completion,
CASE WHEN gold THEN 'Yes' ELSE 'No' END AS label, 'None' AS answer_line FROM h""")
def sft_examples(spark, sf):
    x = prompts.sft_example(F.col("question"), F.col("candidate_solution"), F.lit(None).cast("string"), F.lit(None).cast("string"), text.bool_from_any(F.col("candidate_is_correct")))
    return views.teacher(spark, sf).select("row_id", x.alias("x")).select("row_id", "x.*", verdicts.answer_in_prompt(F.col("x.prompt")).alias("answer_line"))


_ASK = literal("Question:\n") + " || question || " + literal("\n\nCandidate Solution:\n") + " || candidate_solution || " + literal(f"\n\n{prompts.VERIFY}")


@query(f"""WITH {H}, {_T} SELECT row_id, {_ASK} AS user_text, CASE WHEN verdict IS NOT NULL AND NOT contains(answer_text, 'Verification: Is the answer correct') THEN rtrim(answer_text, E' \\t\\n\\r') || chr(10) || {literal(prompts.VERDICT_LINE)} || verdict ELSE answer_text END AS assistant_text FROM tt""")
def verify_messages(spark, sf):
    t = views.teacher(spark, sf)
    m = prompts.verify_messages(F.col("question"), F.col("candidate_solution"), F.col("answer_text"), verdicts.teacher_verdict(F.col("answer_text")))
    return t.select("row_id", m.alias("m")).select("row_id", F.col("m")[0]["content"].alias("user_text"), F.col("m")[1]["content"].alias("assistant_text"))


@query(f"WITH {H} SELECT row_id, {literal('Q: ')} || question || ' [' || candidate_role || '] ' || candidate_solution AS prompt FROM h")
def prompt_fill(spark, sf):
    t = views.teacher(spark, sf)
    return t.select("row_id", prompts.fill(t, "Q: {question} [{candidate_role}] {candidate_solution}").alias("prompt"))


# --- entropy and losses --------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, max(v) AS top FROM x GROUP BY vec_id), e AS (SELECT vec_id, exp(v - top) AS w FROM x JOIN m USING (vec_id)), s AS (SELECT vec_id, sum(w) AS z FROM e GROUP BY vec_id),
h AS (SELECT vec_id, -sum(w / z * ln(w / z)) AS h, count(*) AS n FROM e JOIN s USING (vec_id) GROUP BY vec_id), k AS (SELECT vec_id, avg(v) AS mean, max(v) AS mx, min(v) AS mn, stddev_pop(v) AS sd FROM x GROUP BY vec_id)
SELECT vec_id, round(h, 6) AS entropy, round(h / ln(n), 6) AS normalised, round(mean, 6) AS mean_entropy, round(mx, 6) AS max_entropy, round(mn, 6) AS min_entropy, round(sd, 6) AS std_entropy FROM h JOIN k USING (vec_id)""")
def entropy_of_logits(spark, sf):
    v = F.col("embedding").cast("array<double>")
    e = views.read(spark, sf, "embeddings").select("vec_id", entropy.from_logprobs(v).alias("entropy"), entropy.normalised(v).alias("normalised"), entropy.step_stats(v).alias("s"))
    return rounded(e.select("vec_id", "entropy", "normalised", *[F.col(f"s.{a}").alias(f"{a}_entropy") for a in ("mean", "max", "min", "std")]))


@query("""WITH x AS (SELECT doc_id, unnest(string_split_regex(trim(text, E' \\t\\n\\r'), '\\s+')) AS w FROM documents) SELECT doc_id, count(*) AS n_words, round(avg(ln(length(w))), 6) AS mean_entropy, round(sum(-ln(length(w))), 6) AS total_logprob FROM x WHERE w <> '' GROUP BY doc_id""")
def word_entropy(spark, sf):
    d = views.texts(spark, sf, "doc_id", "text").select("doc_id", F.explode(entropy.word_uniform(F.col("text"))).alias("t"))
    return rounded(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.avg("t.entropy").alias("mean_entropy"), (F.sum("t.logprob") + 0.0).alias("total_logprob")))


_SHIFT = "s AS (SELECT * FROM (SELECT *, lead(label) OVER (PARTITION BY seq ORDER BY pos) AS target FROM t) WHERE target IS NOT NULL AND target <> -100)"
_MASK = f"m AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY entropy DESC, pos) <= greatest(1, floor(count(*) OVER (PARTITION BY seq) * 0.2::DOUBLE)) AS mask FROM s)"


@query(f"WITH {T}, {_SHIFT}, {_MASK} SELECT seq, round(sum(ce * (1 + 0.05::DOUBLE * entropy + CASE WHEN mask THEN 0.5::DOUBLE ELSE 0 END) * CASE WHEN target IN (3, 5) THEN 2 ELSE 1 END) / greatest(1, count(*)), 6) AS loss, count(*) AS n_valid FROM m GROUP BY seq")
def weighted_token_loss(spark, sf):
    m = losses.top_share(losses.shifted(views.tokens(spark, sf)), 0.2)
    return rounded(losses.weighted_loss(m, "ce", losses.weights(F.col("entropy"), F.col("mask"), F.col("target"), (3, 5)), ["seq"]))


@query(f"WITH {T}, {_SHIFT}, q AS (SELECT batch, quantile_cont(entropy, 0.8::DOUBLE) AS q FROM s GROUP BY batch) SELECT batch, round(sum(ce) FILTER (entropy >= q) / (count(*) FILTER (entropy >= q) + 1e-8::DOUBLE), 6) AS loss, count(*) FILTER (entropy >= q) AS n_marked FROM s JOIN q USING (batch) GROUP BY batch")
def quantile_masked_loss(spark, sf):
    m = losses.quantile_mask(losses.shifted(views.tokens(spark, sf)), 0.8)
    return rounded(losses.masked_loss(m, "ce", by=["batch"]))


@query(f"WITH {T}, {_SHIFT} SELECT round(avg(ce), 6) AS loss, count(*) AS n_valid FROM s")
def vanilla_loss(spark, sf):
    return rounded(losses.weighted_loss(losses.shifted(views.tokens(spark, sf)), "ce", F.lit(1.0)))


# --- streams' batch forms --------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return rounded(resume.windowed_counts(views.read(spark, sf, "events")))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return resume.sessions(views.read(spark, sf, "events"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE NOT isnan(value)")
def finite_filter(spark, sf):
    return views.read(spark, sf, "events").where(text.finite(F.col("value"))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return quality.duplicate_ids(views.read(spark, sf, "documents"), "text")


@query(f"WITH {H}, {_T} SELECT count(*) AS rows, count(DISTINCT question) AS questions, count(*) FILTER ({_TRIM.format('answer_text')} = '') AS empty_texts, count(*) FILTER (verdict = 'Yes') AS yes, count(*) FILTER (verdict = 'No') AS no, count(*) FILTER (verdict IS NULL) AS bad_verdicts, count(DISTINCT candidate_role) AS sources, round(avg(length(answer_text)), 6) AS mean_chars FROM tt")
def final_report(spark, sf):
    t = views.teacher(spark, sf).withColumn("v", verdicts.teacher_verdict(F.col("answer_text")))
    return rounded(quality.final_report(t, "question", "answer_text", "v", "candidate_role"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: guarded majority of candidates per question."""
    return guarded_majority(spark, sf_dir)
