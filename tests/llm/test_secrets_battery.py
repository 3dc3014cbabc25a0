"""The randomness battery on planted keys among text-like tokens: recall and false discoveries; spans of very many matches."""

import random
import re

from pyspark.sql import functions as F

from tracelens.llm import secrets

DOCS = "doc_id long, text string, k string"
WORDS = "the and for with that this from have not are was but they which one all would there their will each about how many then them these some her make like him into time has look two more write see number way could people than first water been call who oil its now find long down day did get come made may part".split()


def text_like(rng):
    words = [rng.choice(WORDS) for _ in range(12)]
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(words)[: rng.randint(20, 50)]
    if kind == 1:
        return "".join(w.capitalize() for w in words)[: rng.randint(20, 50)]
    if kind == 2:
        return "_".join(words)[: rng.randint(20, 60)].strip("_")
    if kind == 3:
        return "/".join(words)[: rng.randint(20, 60)].strip("/")
    return "-".join(words)[: rng.randint(20, 60)].strip("-")


def test_planted_keys_are_found_and_text_is_not(spark):
    rng = random.Random(12)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    keys = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([40, 44, 64, 86]))) for _ in range(300)]
    prose = [text_like(rng) for _ in range(3000)]
    texts = [f"see {k} here" for k in keys] + [f"see {t} here" for t in prose]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.spans for r in secrets.secret_scan(rows).collect()}
    found = [i for i, s in got.items() if "random" in s]
    true = [i for i in found if i < len(keys)]
    assert len(true) >= 0.9 * len(keys) and len(found) - len(true) <= 0.01 * len(found) + 1


def test_each_of_the_three_tests_can_reject(spark):
    """Strings that fail one test alone: skewed letters, long runs, and a walk through the alphabet."""
    rng = random.Random(3)
    low, high = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef", "ghijklmnopqrstuvwxyz0123456789+/"
    half = lambda a: [rng.choice(a) for _ in range(60)]
    runs = "".join(half(low) + half(high))
    steps = sorted(rng.choice(low + high) for _ in range(120))
    skew = "".join(rng.choice("ABCDxyz019+/") for _ in range(120))
    good = "".join(rng.choice(low + high) for _ in range(120))
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate([runs, "".join(steps), skew, good])], "i long, t string")
    x = tokens.select("i", secrets.battery(F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.col("t").alias("token"))))[0].alias("x")).collect()
    p = {r.i: r.x["p_random"] for r in x}
    assert p[0] < 1e-6 and p[1] < 1e-6 and p[2] < 1e-6 and p[3] > 1e-3


def test_thresholds_are_those_of_the_step_up_rule():
    rng = random.Random(1)
    for _ in range(50):
        ps = [10 ** -rng.uniform(0, 8) if rng.random() < 0.5 else rng.random() for _ in range(200)]
        bins = {}
        for p in ps:
            b = int(-4 * __import__("math").log10(p) // 1)
            bins[b] = bins.get(b, 0) + 1
        got = secrets.thresholds([{"kind": "text", "cls": 7, "bin": b, "n": n} for b, n in bins.items()], {"text": 0.05, "random": 0.01})
        # the largest edge of a bin at which the share of false discoveries is bounded
        edges = [b for b in bins if 10 ** (-b / 4) * len(ps) <= 0.05 * sum(n for c, n in bins.items() if c >= b)]
        assert got == {"text": {7: min(edges)} if edges else {}, "random": {}}


def test_spans_of_many_matches(spark):
    t = "x 0123456789abcdef0123456789abcdef " * 20_000 + "é🙂 " + "f" * 32
    got = spark.createDataFrame([(t,)], "t string").select(secrets.spans(F.col("t"), secrets.HEX).alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer("[0-9a-f]{32,}", t)]
