"""Every operator on documents: nulls in any column, empty and very long texts, ties, fully repeated rows, clashing columns; each case has one result."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelens.llm import chat, decontam, html_extract, mixing, neardup, secrets, token_counts, token_index, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, size string, taken string, tokens string, y string, hits string, found string, sid string, h string, bands string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocab = ["".join(rng.choice(["an", "er", "to", "li", "ma", "so", "ke", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(30)
    base = [(i, prose(40), "en", f"s{i % 3}") for i in range(60)]
    long = prose(30_000) + " " + item + " grubzak " + "A1b2" * 20 + " " + prose(30_000)
    odd = [(100, None, None, None), (101, "", "", ""), (102, " \n\t ", "xx", None), (None, None, None, None), (None, prose(20), None, "s1"), (103, long, "en", "s2"), (104, item, "en", "s0"), (105, base[3][1], "en", "s0")]
    twice = [base[5], base[5], odd[0], odd[3], odd[6]]
    extra = ("x",) * 11
    return item, [(*r, None if r[1] is None else len(r[1]), *extra) for r in base + odd + twice]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one_result_for_equal_rows(rows, got, digest):
    """As many results as rows, and the same ones for equal (key, text, source)."""
    assert Counter(r[0] for r in rows) == Counter(r["doc_id"] for r in got)
    seen = {}
    for r in got:
        if r["doc_id"] is not None:
            assert seen.setdefault(r["doc_id"], digest(r)) == digest(r)
    return seen


def test_toxicity(spark, rows):
    item, data = rows
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(spark, data), labels).collect()
    seen = one_result_for_equal_rows(data, got, lambda r: (r["held_out"], r["score"], r["predicted"]))
    assert seen[100] == seen[100] and seen[100][1] == seen[101][1] == seen[102][1] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_mixing(spark, rows):
    _, data = rows
    got = mixing.mix_sources(docs_of(spark, data)).collect()
    assert Counter(r[0] for r in data) == Counter(r["doc_id"] for r in got)
    assert all(0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0) == (r["first_slot"] is None) for r in got)
    assert {(r["size"], r["taken"]) for r in got if r["doc_id"] in (100, 101, 102)} == {(0, 0)}


def test_near_duplicates_with_null_keys_and_repeats(spark, rows):
    item, data = rows
    got = neardup.near_duplicates(docs_of(spark, data)).collect()
    seen = one_result_for_equal_rows(data, got, lambda r: (r["n_shingles"], r["component_id"], r["kept"]))
    assert seen[105] == (36, 3, False) and seen[100] == (0, 100, True) and seen[101] == (0, 101, True) and seen[5][1] == 5
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and sum(r["n_shingles"] > 0 for r in got if r["doc_id"] is None) == 1


def test_secrets(spark, rows):
    _, data = rows
    got = secrets.secret_scan(docs_of(spark, data)).collect()
    seen = one_result_for_equal_rows(data, got, lambda r: (r["n_hex"], r["base_sha256"], r["spans"]))
    assert seen[100] == seen[101] == seen[102]


def test_token_counts_and_index(spark, rows):
    _, data = rows
    counts = token_counts.token_counts(docs_of(spark, data), P.path("piece_bpe_32k.model")).collect()
    seen = one_result_for_equal_rows(data, counts, lambda r: (r["n_bytes"], r["n_tokens"], r["over_limit"]))
    assert seen[100][:2] == seen[101][:2] == (0, 0) and seen[103][2]
    index = token_index.token_index(docs_of(spark, data), P.path("word_bpe_49k.json")).collect()
    one_result_for_equal_rows(data, index, lambda r: (r["n_tokens"], r["ids_crc32"]))
    index.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in index] == sorted(r["doc_id"] is not None for r in index) and len({r["start"] for r in index}) == len(data)


def test_decontamination(spark, rows):
    item, data = rows
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (2, item, "x"), (None, item, "x"), (3, None, "x"), (4, " ", "x")], "item_id long, text string, t string")
    got = decontam.contaminated(docs_of(spark, data), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (103, 104) for i in (1, 2, None)}
    kept = decontam.decontaminated(docs_of(spark, data), bench).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r[0] for r in data if r[0] not in (103, 104))


def test_pages_and_dialogues(spark, rows):
    _, data = rows
    pages = docs_of(spark, data).select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "k", "h", "t")
    got = html_extract.extract_pages(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in data)
    turns = docs_of(spark, data).select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), "text", F.col("k").alias("who"), F.col("t").alias("body"))
    out = chat.perspectives(turns).collect()
    assert Counter(r["conv_id"] for r in out)[103] == 1 and next(r for r in out if r["conv_id"] == 103)["segment"].endswith("<|im_end|>\n")
    # both rows of a repeated turn stand in each of their speaker's dialogues
    assert sorted(r["pos"] for r in out if r["conv_id"] == 5) == [0, 1, 2]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [
        toxicity.toxicity(none, labels), mixing.mix_sources(none), neardup.near_duplicates(none), secrets.secret_scan(none), token_counts.token_counts(none, P.path("piece_bpe_32k.model")),
        token_index.token_index(none, P.path("word_bpe_49k.json")), decontam.contaminated(none, bench), decontam.decontaminated(none, bench),
    ]
    assert all(df.count() == 0 for df in results)
