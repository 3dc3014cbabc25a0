"""Operators on small tables, checked against plain Python."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelens.operators import groups, losses, metrics, quality, select
from tracelens.sources import tables
from tracelens.streaming import resume

COLS = "q string, pos int, ans string, score double, yes boolean, ok boolean"


def made(n=200, seed=3):
    rng = random.Random(seed)
    return [(f"q{rng.randrange(40)}", i, rng.choice("abc"), rng.random(), rng.random() < 0.4, rng.random() < 0.5) for i in range(n)]


def by_question(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_majority_first_wins_ties(spark):
    rows = [("x", 0, "b"), ("x", 1, "a"), ("x", 2, "a"), ("x", 3, "b"), ("y", 4, None)]
    got = {r.q: (r.answer, r.votes, r.n_tied) for r in select.majority(spark.createDataFrame(rows, "q string, pos int, ans string")).collect()}
    assert got == {"x": ("b", 2, 2), "y": (None, 1, 1)}


def draws(*sizes):
    """Places that a generator seeded with 42 picks in turn."""
    rng = random.Random(42)
    return [rng.choice(range(n)) for n in sizes]


#: Answers of a question in order, upper case where judged Yes, with what is to come out: strategy, answer and its draws.
GUARD = {
    "abb": ("B_no_yes_global", "b", [1, 2], draws(1, 2)[1]),
    "ab": ("B_no_yes_global", "ab"[draws(2, 1)[0]], [draws(2, 1)[0]], 0),
    "aabbcc": ("B_no_yes_global", "abc"[draws(3, 2)[0]], [2 * draws(3, 2)[0], 2 * draws(3, 2)[0] + 1], draws(3, 2)[1]),
    "AABbb": ("B_conflict_guard_global", "b", [2, 3, 4], draws(3)[0]),
    "AAbbb": ("B_yes_majority", "a", [0, 1], draws(1, 2)[1]),  # b has no Yes
    "AABbbaa": ("B_yes_majority", "a", [0, 1], draws(1, 2)[1]),  # a leads in both
    "AABbbcccC": ("B_conflict_guard_global", "c", [5, 6, 7, 8], draws(4)[0]),
    "AABBccccC": ("B_yes_majority", "ab"[draws(2, 2)[0]], [[0, 1], [2, 3]][draws(2, 2)[0]], draws(2, 2)[1]),  # two lead among Yes
    "AaBb": ("B_yes_majority", "ab"[draws(2, 1)[0]], [[0], [2]][draws(2, 1)[0]], 0),
    "a" * 300 + "b" * 1000: ("B_no_yes_global", "b", list(range(300, 1300)), draws(1, 1000)[1]),
    "".join(chr(0x4E00 + i) for i in range(700)): ("B_no_yes_global", chr(0x4E00 + draws(700, 1)[0]), [draws(700, 1)[0]], 0),
}


def test_guarded_majority_by_hand(spark):
    rows = [(name, i, x.lower(), 0.0, x.isupper(), True) for name in GUARD for i, x in enumerate(name)]
    got = {r.q: (r.strategy, r.answer, r.chosen_pos) for r in select.guarded_majority(spark.createDataFrame(rows, COLS), F.col("yes")).collect()}
    assert got == {q: (strategy, answer, places[i]) for q, (strategy, answer, places, i) in GUARD.items()}


def test_seeded_places_of_any_size(spark):
    sizes = [*range(1, 700), 1000, 4096, 65_537, 10**6, 2**31, 2**32 - 1]
    rows = spark.createDataFrame([(n, f) for n in sizes for f in (1, 2, 3, 9, 300)], "n long, f long")
    for r in rows.select("n", "f", select.place_in_pool(F.col("n")).alias("one"), select.second_place(F.col("f"), F.col("n")).alias("two")).collect():
        assert (r.one, r.two) == (draws(r.n)[0], draws(r.f, r.n)[1])


def test_pool_pick_is_the_seeded_choice(spark):
    rows = made() + [("hot", 3 * i - 5000, "a", 0.0, i % 2 == 0, True) for i in range(5000)] + [("none", i, "a", 0.0, None, None) for i in range(3)]
    got = {r.q: r.chosen_pos for r in select.pool_pick(spark.createDataFrame(rows, COLS), F.col("yes")).collect()}
    assert got == {q: random.Random(42).choice([c for c in cs if c[4]] or cs)[1] for q, cs in by_question(rows).items()}


def test_confidence_missing_entropy_wins(spark):
    rows = [("x", 0, "a", None, 0.5), ("x", 1, "b", None, None), ("y", 2, "a", -1.0, 0.0), ("y", 3, "b", -0.5, 9.0), ("y", 4, "c", -0.5, 0.0)]
    got = {r.q: r.answer for r in select.by_confidence(spark.createDataFrame(rows, "q string, pos int, ans string, logprob double, entropy double")).collect()}
    assert got == {"x": "b", "y": "b"}


def test_group_split_is_whole_and_sized(spark):
    rows = [(f"k{i % 189}", i) for i in range(757)]
    out = groups.group_split(spark.createDataFrame(rows, "q string, i int"), "q")
    assert groups.leaks(out, "q").count() == 0
    assert {r.split: r.n for r in out.groupBy("split").agg(F.count_distinct("q").alias("n")).collect()} == {"train": 113, "valid": 38, "test": 38}


def test_cascade_has_one_row_per_reason(spark):
    long = "x" * 90
    rows = [
        {"status": "bad", "answer_text": long}, {"status": "ok", "answer_text": "short"}, {"status": "ok", "answer_text": long}, {"status": "ok", "answer_text": long + "\nFinal Verdict: Yes", "candidate_is_correct": "n"},
        {"status": "ok", "answer_text": long + "\nFinal Verdict: No", "candidate_is_correct": "0"}, {"status": "ok", "answer_text": long + "\nFinal Verdict: yes", "candidate_is_correct": None},
    ]
    df = spark.createDataFrame([(i, r["status"], r["answer_text"], r.get("candidate_is_correct")) for i, r in enumerate(rows)], "i int, status string, answer_text string, candidate_is_correct string")
    reasons = [r.reject_reason for r in quality.judged(df).orderBy("i").collect()]
    assert reasons == ["status_not_ok", "rationale_too_short", "missing_or_invalid_final_verdict", "verdict_label_mismatch", None, None]
    assert [r.reject_reason for r in quality.judged(df, need_error=True).orderBy("i").collect()][4] == "missing_earliest_error_for_wrong"
    assert sum(r.n for r in quality.reject_counts(quality.judged(df)).collect()) == len(rows)


def test_issues(spark):
    token = lambda i, lp=0.0, e=0.0: {"token_index": i, "logprob": lp, "entropy": e}
    step = lambda a, b, m=0.0: {"start_token": a, "end_token": b, "mean_entropy": m, "max_entropy": 0.0, "min_entropy": 0.0, "std_entropy": 0.0}
    cands = [
        {"reasoning_text": "", "predicted_answer_raw": "", "predicted_answer_normalized": "", "tokens": [], "steps": [step(0, 0)]},
        {"reasoning_text": "t", "predicted_answer_raw": "", "predicted_answer_normalized": "", "tokens": [token(0, math.nan), token(0)], "steps": [step(3, 1, math.nan), step(-1, 9)]},
    ]
    df = spark.createDataFrame([("s", "", "q", None, "", None, None, cands)], tables.schemas.SAMPLE.replace("dataset string, sample_id string", "sample_id string, dataset string"))
    got = sorted((r.check, r.severity, r.message, r.candidate_index) for r in quality.issues(df).collect())
    assert ("missing_fields", "error", "dataset is missing or empty", None) in got and ("missing_fields", "warning", "answer_raw is None", None) in got
    assert ("entropy_mismatch", "warning", "token_index 0 at position 1 (expected contiguous 0..1)", 1) in got and ("entropy_mismatch", "warning", "duplicate token_index 0", 1) in got
    assert ("nan_values", "warning", "non-finite token logprob/entropy at indices [0]", 1) in got and ("entropy_mismatch", "warning", "step[1] end_token 9 > len(tokens)=2", 1) in got
    assert ("entropy_mismatch", "warning", "step[0] present but tokens list is empty", 0) in got and len(got) == 13


def test_scores_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "p boolean, g boolean")
    r = metrics.classification(df, F.col("p"), F.col("g")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_masks_and_truncation(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, 2.0), ("b", 2, 2.0)], "seq string, pos int, entropy double")
    assert {(r.seq, r.pos) for r in losses.top_share(df, 0.1).where("mask").collect()} == {("a", 0), ("b", 0)}
    assert losses.quantile_mask(df.withColumnRenamed("seq", "batch"), 0.8).where("mask").count() == 4
    ids = spark.createDataFrame([([1, 2, 3], [7, 8])], "p array<int>, c array<int>")
    kept = lambda n: ids.select(losses.kept_completion(F.col("p"), F.col("c"), n).alias("x")).first().x
    assert (kept(4), kept(9), kept(2)) == ([2, 3, 7, 8], [1, 2, 3, 7, 8], [1, 2])
    assert ids.select(losses.masked_labels(F.col("p"), F.lit(1), 3, 5).alias("x")).first().x == [-100, 2, 3, -100, -100]


def test_ledger_and_files(spark, tmp_path):
    f = tmp_path / "ledger.jsonl"
    f.write_text('{"sample_id": "a"}\n\n{"sample_id": 3}\n{"sample_id": "b"}\n{"sample_id": "to')
    assert {r.sample_id for r in tables.completed_ids(spark, str(f)).collect()} == {"a", "b"}
    assert tables.completed_ids(spark, str(tmp_path / "missing")).count() == 0
    tables.write_jsonl(spark.createDataFrame([("x", math.nan), ("y", 1.0)], "sample_id string, v double"), str(tmp_path / "out"))
    lines = sorted(line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"sample_id": "x", "v": None}, {"sample_id": "y", "v": 1.0}]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(bad), "sample_id string").collect()
    csv = tmp_path / "t.csv"
    csv.write_bytes(b'\xef\xbb\xbfid,name\n1,"a\nb"\n')
    assert tables.read_table(spark, str(csv)).columns == ["id", "name"]


def test_the_first_step_checks_before_it_writes(spark, tmp_path):
    from tracelens.operators import generate

    rows = [("d", "", "q", "#### 1", "", None, {"k": "v"}), ("d", "s1", "q", "#### 2", "", None, {"k": "v"})]
    samples = spark.createDataFrame(rows, tables.schemas.CLEANED)
    config = tables.GenerationConfig(k=2)
    with pytest.raises(ValueError, match="errors"):
        generate.run_step_one(spark, samples, str(tmp_path / "a"), "echo", config, strict=True)
    assert not (tmp_path / "a").exists()
    found = generate.run_step_one(spark, samples, str(tmp_path / "a"), "echo", config, "per_word_uniform").collect()
    assert {(r.sample_id, r.check, r.severity) for r in found} >= {("<missing>", "missing_fields", "error")}
    done = resume.side_table(spark, str(tmp_path / "a"), "step1_dataset").collect()
    assert {(r.sample_id, r.answer_normalized) for r in done} == {("", "1"), ("s1", "2")} and [c.predicted_answer_raw for c in done[0].candidates] == ["0", "1"]
    assert generate.step_one(samples, "echo", tables.GenerationConfig(k=0)).first().candidates == []
    with pytest.raises(ValueError, match="entropy mode"):
        generate.with_entropy(F.col("candidates"), "other")
    with pytest.raises(ValueError, match="backend"):
        generate.make_backend("none")


def test_echo_and_function_backends(spark):
    df = spark.createDataFrame([("q1",)], "question string")
    cfg = tables.GenerationConfig(k=2)
    assert tables.echo_candidates(df, cfg).first().texts == ["#### 0", "#### 1"]
    assert tables.function_candidates(df, lambda q, i: f"{q}-{i}", cfg).first().texts == ["q1-0", "q1-1"]
    with pytest.raises(ValueError):
        tables.echo_candidates(df, tables.GenerationConfig(k=0))


def sample(i):
    token = {"token_index": 0, "logprob": -1.0, "entropy": 1.0}
    return {"dataset": "d", "sample_id": f"s{i}", "question": "q", "answer_raw": "a", "answer_normalized": "a", "split": None, "metadata": {}, "candidates": [{"reasoning_text": "t", "predicted_answer_raw": "1", "predicted_answer_normalized": "1", "tokens": [token], "steps": []}]}


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    write = lambda name, ids: (tmp_path / "in" / name).write_text("".join(json.dumps(sample(i)) + "\n" for i in ids))
    write("a.json", range(3))
    go = lambda c: resume.run(spark, source, tables.schemas.SAMPLE, out, lambda df: df, c).awaitTermination()
    go(ckpt)
    write("b.json", range(1, 5))
    go(ckpt)
    go(ckpt + "-lost")  # a lost checkpoint reads everything again; the ledger keeps it from being done twice
    assert sorted(r.sample_id for r in resume.ledger(spark, out).collect()) == [f"s{i}" for i in range(5)]
    assert resume.side_table(spark, out, "entropy_features").count() == 5


def test_streams_of_events(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit(1).alias("user_id")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    q = resume.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("w").collect()) == sorted(resume.windowed_counts(batch).collect())
    assert resume.sessions(batch).count() == 1


def test_queries_match_their_sql(spark):
    """Every query of the smallest tables against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from tracelens.plans import more, queries

    assert more.scratch  # importing it registers its queries
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no tables here")
    db = duckdb.connect()
    for p in d.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v
    for name, f in queries.QUERIES.items():
        df = f(spark, str(d))
        cols = sorted(df.columns)
        rel = db.sql(queries.SQL[name])
        at = [rel.columns.index(c) for c in cols]
        key = lambda r: [str(x) for x in r]
        got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=key)
        want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=key)
        assert got == want, name
