"""The pipeline's stages on odd tables: clashing and dotted columns, nulls, empty and long texts, repeated rows and keys, empty tables."""

import random

import pytest

import corpus_pipeline
from tracelens.llm import stages, toxicity
from tracelens.llm.common import fresh, quoted

EXTRA = ["_hits", "_n", "_score", "_id", "_times", "_copy", "_slot", "_hash", "_node", "_v", "a.b", "k", "t", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
FOUR = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice(["an", "er", "to", "li", "ma", "so", "ke", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(2500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(40)
    texts = [prose(120) for _ in range(240)]
    toxic = set(range(0, 240, 6))
    for i in toxic:
        texts[i] += " grubzak morvex grubzak"
    texts[1] = f"{prose(40)} {item} {prose(40)}"
    texts[3] = texts[2]
    rows = [(i, t, "en", f"s{i % 3}", len(t), *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts)]
    odd = lambda i, t: (i, t, None, None, None, *[None] * len(EXTRA))
    long = prose(60_000)
    rows += [odd(500, None), odd(501, ""), odd(502, "  \n "), odd(None, "no key at all"), odd(None, "no key at all"), odd(None, None), odd(503, long), odd(504, texts[7]), odd(504, texts[7]), odd(505, prose(30))]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, 1, int(i in toxic), "clash") for i in range(240)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item, "clash"), (2, None, None), (3, "", None)], "item_id long, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, toxic


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ids(rows):
    return [r[0] for r in rows]


def test_rows_pass_through_unchanged(spark, corpus):
    d, rows, toxic = corpus
    docs = made(spark, rows)
    got = {name: stage(spark, docs, d) for name, stage in FOUR}
    assert all(df.columns == docs.columns and df.schema.simpleString() == docs.schema.simpleString() for df in got.values())
    assert ids(as_tuples(got["toxicity"])) == ids(sorted((r for r in rows if r[0] not in toxic), key=str))
    assert as_tuples(got["toxicity"]) == sorted((r for r in rows if r[0] not in toxic), key=str)
    assert as_tuples(got["benchmark_decontamination"]) == sorted((r for r in rows if r[0] != 1), key=str)
    kept = as_tuples(got["minhash_near_dedup"])
    assert kept == sorted((r for r in rows if r[0] not in (3, 504)), key=str)
    mixed = as_tuples(got["source_mixing"])
    assert set(mixed) <= set(rows) and all(mixed.count(r) <= 2 * rows.count(r) for r in set(mixed))
    assert not {500, 501, 502} & {r[0] for r in mixed}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert out.count() == len(rows) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_tables(spark, corpus):
    d, _, _ = corpus
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, made(spark, []), d).count() == 0, name


def test_different_texts_of_one_key_are_judged_each(spark, corpus):
    d, rows, _ = corpus
    other = lambda i, t: (i, t, None, None, None, *[str(i)] * len(EXTRA))
    a, b, c = (r[1] for r in rows if r[0] in (7, 8, 9))
    docs = made(spark, [other(7, a), other(7, b), other(7, b), other(-2, c), other(9, a), other(8, c + " more"), other(10, None), other(10, ""), other(None, a)])
    kept = [(r.doc_id, r.text) for r in stages.drop_near_copies(spark, docs, d).collect()]
    assert sorted(kept, key=str) == sorted([(7, a), (7, b), (-2, c), (10, None), (10, ""), (None, a)], key=str)


def test_mix_is_in_the_order_of_the_schedule(spark, corpus):
    from tracelens.llm import mixing

    d, rows, _ = corpus
    docs = made(spark, [r for r in rows if r[0] is not None and r[0] < 240])
    first = {r.doc_id: r.first_slot for r in mixing.mix_sources(docs).collect()}
    got = [r.doc_id for r in stages.mix(spark, docs, d).collect()]
    firsts = [first[i] for n, i in enumerate(got) if i not in got[:n]]
    assert len(firsts) > 50 and firsts == sorted(firsts)


def test_fresh_names_clash_with_nothing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_A long, _a_ long, `x.y` long")
    assert fresh(df, "_a", "_a", "b") == ["_a__", "_a___", "b"] and df.select(quoted("x.y")).first()[0] == 3


def test_scores_are_those_of_a_plain_scorer(spark, corpus):
    """The fitted model's scores of all rows against a plain scorer: every word restored by a search over all readings."""
    import itertools
    import math

    d, rows, _ = corpus
    docs, labels = made(spark, rows), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored, score, hits = toxicity.score_rows(docs, labels)
    scorer = toxicity.Scorer(model.channel.value, model.lexicon)
    for r in scored.collect():
        words = scorer.r(r.text or "")
        h = sum(max(sum(max(model.lexicon.get(x, 0.0) for x in toxicity.stems(w)) for w in reading.split(" ")) for reading in scorer.r.readings(w)) for w in words)
        n, w = len(words), model.weights
        z = w[0] + min(h, 1) * w[1] + math.log1p(h) * w[2] + math.log1p(1000 * h / max(n, 1)) * w[3]
        assert abs(r[hits] - h) < 1e-9 and abs(r[score] - 1 / (1 + math.exp(-z))) < 1e-9

    def all_readings(word):
        """The cheapest of all readings, one by one."""
        options, last = [], ""
        for ch in word:
            if ch in toxicity._CODE:
                options.append([(ch, toxicity.KEEP_REPEAT), ("", toxicity.DROP_REPEAT)] if ch == last else [(ch, 0.0)])
            else:
                options.append([(x, toxicity.AS_LETTER) for x in toxicity.LEET.get(ch, "")] + [("", toxicity.DROP_SIGN)])
            last = ch
        best = (math.inf, "")
        for way in itertools.product(*options):
            text = "".join(x for x, _ in way)
            codes = [0, 0, *[toxicity._CODE[x] for x in text], 0]
            cost = sum(c for _, c in way) + sum(float(scorer.r.channel.cost[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))
            best = min(best, (cost, text), key=lambda x: x[0])
        return best

    rng = random.Random(6)
    for _ in range(60):
        word = "".join(rng.choice("anertolimasokeru014$*|.") for _ in range(rng.randint(3, 9)))
        assert scorer.r.channel.restore(word) == all_readings(word)[1], word
