"""Findings of a review: keys longer than their pads, words beyond ASCII, and what grows with the tables."""

import re

from pyspark.sql import functions as F

from tracelens.functions import entropy, text, verdicts
from tracelens.operators import segment
from tracelens.plans import more
from tracelens.sources import tables
from tracelens.streaming import resume


def test_long_keys_stay_whole(spark):
    k = F.lit(1234567)
    r = spark.range(1).select(text.sample_key("gsm8k", F.lit("train"), k).alias("s"), text.stable_id([F.lit("")], k, F.lit("{}")).alias("i")).first()
    assert r.s == "gsm8k:train:1234567" and r.i.startswith("row_1234567_")


def test_verdict_words_end_at_letters_of_any_alphabet(spark):
    df = spark.createDataFrame([("que noñadoeses yesñtaque",), ("no. yesñtaque",)], "t string").select(verdicts.evaluation_verdict(F.col("t")), verdicts.tag_verdict(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [(None, None), ("No", "No")]


def test_a_step_measures_and_copies_no_whole_text(spark):
    """The plan fetches tokens by place and takes the text's length once, not for each step."""
    df = spark.createDataFrame([("A b. " * 50,)], "t string")
    steps = segment.segment(F.col("t"), F.transform(entropy.word_uniform(F.col("t")), lambda x: x["entropy"]))
    tree = str(df.select(steps.alias("s"))._jdf.queryExecution().analyzed())
    assert tree.count("length(t#") == 1 + 1  # once for the steps, once for a text that is one paragraph
    got = df.select(F.explode(steps).alias("s")).select("s.*").collect()
    assert [(r.start_token, r.end_token) for r in got] == [(2 * i, 2 * i + 2) for i in range(50)] and all(r.mean_entropy == r.max_entropy / 2 for r in got)


def test_step_features_makes_steps_once_and_in_small_parts(spark, tmp_path):
    texts = [(0, "One. Two three."), (1, None), (2, ""), (3, "  "), (4, "\n\n")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = more.step_features(spark, str(tmp_path))
    assert not re.search(r"Filter \(*size\(", df._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.doc_id, r.n_steps, r.starts, r.ends) for r in df.collect() if r.doc_id == 0] == [(0, 2, 1, 4)]


def test_fine_parts_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(20000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(tables, "SMALL", 100_000)
    df = tables.spread(spark.read.parquet(f"{tmp_path}/t"), fine=True)
    assert df.rdd.getNumPartitions() >= 8 and df.count() == 20000


def test_export_makes_samples_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    candidate = F.array(F.struct(F.lit("r").alias("reasoning_text"), F.lit("1").alias("predicted_answer_raw"), F.lit("1").alias("predicted_answer_normalized"), F.array(F.struct(F.lit(0).alias("token_index"), F.lit(-0.5).alias("logprob"), F.lit(0.5).alias("entropy"))).alias("tokens")))
    df = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), F.lit("d").alias("dataset"), F.lit("train").alias("split"), candidate.alias("candidates"))
    tables.export(df.mapInArrow(seen, df.schema), str(tmp_path))
    assert made.value == 40
    assert [spark.read.text(f"{tmp_path}/{n}.jsonl").count() for n in ("cleaned_samples", "candidate_paths", "entropy_features", "step1_dataset")] == [40] * 4
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_headers_cut_the_text_once(spark):
    df = spark.createDataFrame([("Step 1: a\nStep 2: b\n step 3 c",), ("  Step 1 x",), ("intro\nStep 1 x",), ("none",), ("",), (None,)], "t string").select(segment.header_spans(F.col("t")).alias("s"))
    assert str(df._jdf.queryExecution().analyzed()).count("split(t#") == 1  # not within the lambda over headers
    got = [None if r.s is None else [(x.s, x.e, x.text) for x in r.s] for r in df.collect()]
    assert got == [[(0, 9, "Step 1: a"), (9, 19, "\nStep 2: b"), (19, 29, "\n step 3 c")], [(0, 10, "  Step 1 x")], [(0, 5, "intro"), (5, 14, "\nStep 1 x")], None, None, None]


def test_ledger_rows_are_read_without_a_join(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "sample_id string, x int")
    rows.write.parquet(f"{tmp_path}/step1_dataset")
    df = resume.side_table(spark, str(tmp_path), "step1_dataset")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, df.collect())) == [("a", 1), ("b", 2)]
