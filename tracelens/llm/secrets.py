"""Secret scans: base patterns and a battery of randomness tests, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns. The battery
looks at every other token of `MIN_TOKEN` or more characters of the base64url alphabet
that touches no base span. For each it

* infers the encoding (hex, base32, base62 or base64: the smallest whose alphabet holds it)
  and takes its letters as symbols of that alphabet;
* tests them for uniformity of the alphabet (chi-squared), for runs (of symbols in the upper
  and lower half of the alphabet) and for serial correlation at lag one. The least of the three p
  values under randomness, times three (Bonferroni), is the token's p value of being random;
* takes the p value of the chi-squared statistic under the opposite hypothesis, text: the
  statistic of a text-like string of its length is about normal with mean k - 1 + n * SKEW
  and variance 2 (k - 1) + 4 n * SKEW. Long strings can reach small values, short ones can't.

Within each class of lengths (powers of two) and encoding, the Benjamini-Hochberg rule is applied to both p values
over all tokens of the table: at `ALPHA` to the battery's, which names the tokens that aren't random (of them at most a share ALPHA
wrongly), and at `FDR` to that of text, which names those that aren't text. A secret is what the second names and the first doesn't.
P values are counted in bins of their exponent, and the largest bin whose bound holds is the threshold. Bins, not
tokens, meet in one place, so the table of counts stays small at any size.

Nulls and empty texts have no span. Very long texts are scanned whole; a token of any length is
tested from its symbol counts. Repeated rows give rows of their own. Empty table: empty
result. Extra columns are ignored. Offsets are code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lengths_before, let
from .common import checkpointed, quoted, spread

#: Fixed patterns of the base scan: kind, finder, and what a match must also be. Runs below the least length
#: hold no match that counts, so the finders of the last two ask for it at once.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_OK = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
BASE = (("assign", ASSIGN, ASSIGN_OK), ("access", ACCESS, None), ("hex", HEX, None))

#: Parameters of the battery.
MIN_TOKEN, ALPHA, FDR, BINS = 20, 0.01, 0.001, 240
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % MIN_TOKEN
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, smallest alphabet first; the last takes the signs of base64 and base64url alike.
ALPHABETS = (("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"))
#: Chance that two symbols of a text-like token are the same: of letters, and of digits alone.
SAME_LETTER, SAME_DIGIT = 0.066, 0.1


def spans(text: Column, pattern: str, ok: str | None = None) -> Column:
    """array<struct<start, end, token>> of the matches of a pattern that never matches nothing.

    The pieces between matches and the matches themselves come in order, so their lengths give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("token"))

    def placed(ps: Column) -> Column:
        before = lengths_before(F.transform(ps, lambda p: (F.length(p["gap"]) + F.length(p["token"])).cast("long")))
        start = lambda x: (x["at"] + F.length(x["p"]["gap"])).cast("int")
        spans = F.transform(
            F.arrays_zip(ps.alias("p"), before.alias("at")),
            lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["p"]["token"])).alias("end"), x["p"]["token"].alias("token")),
        )
        return spans if ok is None else F.filter(spans, lambda x: x["token"].rlike(ok))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, to a few percent of itself up to z = 6, within a factor of two far out (polynomial approximation of Mills' ratio)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _with(x: Column, old: list[str], **new: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in old], *[v.alias(k) for k, v in new.items()])


def battery(tokens: Column) -> Column:
    """Adds to array<struct<start, end, token>> the encoding, the p values and the class of each token. Step by step, so that no value is computed twice."""
    cols = ["start", "end", "token"]

    def encoding(x):
        e = F.when(F.lit(False), F.lit(0))
        for i, (_, letters) in enumerate(ALPHABETS[:-1]):
            e = e.when(F.translate(x["token"], letters, "") == "", F.lit(i))
        e = e.otherwise(F.lit(len(ALPHABETS) - 1))
        return _with(x, cols, enc=e, text=F.translate(x["token"], "-_", "+/"), n=F.length(x["token"]).cast("double"))

    def codes(x):
        letters = F.element_at(F.array(*[F.lit(a) for _, a in ALPHABETS]), x["enc"] + 1)
        symbols = F.split(x["text"], "")
        return _with(x, [*cols, "enc", "text", "n"], k=F.length(letters).cast("double"), xs=F.transform(symbols, lambda c: F.instr(letters, c).cast("double")), distinct=F.array_distinct(symbols))

    def sums(x):
        xs, zero = x["xs"], F.lit(0.0)
        total = lambda a, f: F.aggregate(a, zero, lambda s, v: s + f(v))
        return _with(
            x, [*cols, "enc", "n", "k", "xs"],
            squares=total(x["distinct"], lambda c: F.pow(x["n"] - F.length(F.replace(x["text"], c, F.lit(""))), F.lit(2.0))),
            mean=total(xs, lambda v: v) / x["n"], upper=total(xs, lambda v: F.when(v > x["k"] / 2, 1.0).otherwise(0.0)),
        )

    def statistics(x):
        half = x["k"] / 2
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("var"))

        def step(a, v):
            turns = F.when((a["last"] < 0) | ((v > half) != (a["last"] > half)), 1.0).otherwise(0.0)
            lag = F.when(a["last"] < 0, 0.0).otherwise((v - x["mean"]) * (a["last"] - x["mean"]))
            return F.struct(v.alias("last"), (a["runs"] + turns).alias("runs"), (a["lag"] + lag).alias("lag"), (a["var"] + F.pow(v - x["mean"], F.lit(2.0))).alias("var"))

        return _with(x, [*cols, "enc", "n", "k", "upper"], chi=x["squares"] * x["k"] / x["n"] - x["n"], walk=F.aggregate(x["xs"], start, step))

    def scores(x):
        n, k, up, w = x["n"], x["k"], x["upper"], x["walk"]
        low = n - up
        mu = 2.0 * up * low / n + 1.0
        var = (mu - 1.0) * (mu - 2.0) / (n - 1.0)
        runs = F.when((up > 0) & (low > 0) & (var > 0), (w["runs"] - mu) / F.sqrt(var)).otherwise(F.lit(37.0))
        serial = F.when(w["var"] > 0, w["lag"] / w["var"] * F.sqrt(n)).otherwise(F.lit(37.0))
        df = k - 1.0
        cube = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        skew = F.when(k <= 16, k * SAME_DIGIT - 1.0).otherwise(k * SAME_LETTER - 1.0)
        as_text = (x["chi"] - df - n * skew) / F.sqrt(2.0 * df + 4.0 * n * skew)
        return _with(x, [*cols, "enc", "n"], p_uniform=normal_tail(cube), p_runs=2.0 * normal_tail(F.abs(runs)), p_serial=2.0 * normal_tail(F.abs(serial)), p_text=normal_tail(-as_text))

    def classes(x):
        worst = F.least(3.0 * F.least(x["p_uniform"], x["p_runs"], x["p_serial"]), F.lit(1.0))
        exponent = lambda p: F.greatest(F.least(F.floor(F.log10(F.greatest(p, F.lit(1e-300))) * -4.0), F.lit(BINS)).cast("int"), F.lit(0))
        cls = x["enc"] * 64 + F.floor(F.log2(x["n"])).cast("int")
        return F.struct(x["start"], x["end"], x["enc"], cls.alias("cls"), exponent(x["p_text"]).alias("bin"), exponent(worst).alias("odd"), x["p_text"], worst.alias("p_random"))

    for f in (encoding, codes, sums, statistics, scores, classes):
        tokens = F.transform(tokens, f)
    return tokens


def thresholds(counts: list, levels: dict[str, float]) -> dict[str, dict[int, int]]:
    """Benjamini-Hochberg by class over binned p values: for each kind of p value and class the least bin (largest p value) that is a discovery.

    `counts` has kind, cls, bin and n, how many tokens: at most one row for each."""
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        by.setdefault((r["kind"], r["cls"]), {})[r["bin"]] = r["n"]
    out: dict[str, dict[int, int]] = {kind: {} for kind in levels}
    for (kind, cls), bins in by.items():
        total, at_most = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            at_most += bins[b]
            if 10 ** (-b / 4) * total <= levels[kind] * at_most:
                out[kind][cls] = b
    return out


def secret_scan(docs: DataFrame, fdr: float = FDR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, found (all spans as array<struct<start, ord, end, kind>>)."""
    t = F.coalesce(quoted(text), F.lit(""))
    d = spread(docs.select(quoted(key).alias(key), quoted(text).alias(text))).select(quoted(key).alias("k"), *[spans(t, p, ok).alias(kind) for kind, p, ok in BASE], spans(t, TOKEN).alias("tokens"))
    place = lambda i, kind: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.array_sort(F.concat(*[F.transform(kind, place(i, kind)) for i, (kind, _, _) in enumerate(BASE)]))
    d = d.select("k", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, _, _ in BASE], base.alias("base"), "tokens")
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = checkpointed(d.select("k", "n_assign", "n_access", "n_hex", "base", battery(free).alias("tested")))
    kinds = F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.col("x.bin").alias("bin")), F.struct(F.lit("random").alias("kind"), F.col("x.odd").alias("bin"))))
    binned = d.select(F.explode("tested").alias("x")).select("x.cls", kinds.alias("b")).select("cls", "b.kind", "b.bin")
    least = thresholds(binned.groupBy("kind", "cls", "bin").agg(F.count(F.lit(1)).alias("n")).collect(), {"text": fdr, "random": ALPHA})

    def named(kind: str, x: Column, b: str) -> Column:
        pairs = [F.lit(v) for kv in least[kind].items() for v in kv]
        limit = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
        return F.coalesce(x[b] >= F.try_element_at(limit, x["cls"]), F.lit(False))

    hits = F.filter("tested", lambda x: named("text", x, "bin") & ~named("random", x, "odd"))
    d = d.select("k", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", F.transform(hits, place(len(BASE), "random")))).alias("found"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select(F.col("k").alias(key), "n_assign", "n_access", "n_hex", F.sha2(line("base"), 256).alias("base_sha256"), line("found").alias("spans"), "found")
