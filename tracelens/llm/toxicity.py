"""Toxicity by noisy-channel deobfuscation.

1. Language model: trigrams of characters (a fixed alphabet of Latin letters, everything else
   is a word edge) over the whole texts of all documents, counted in arrays per batch and
   summed. At most ALPHABET**3 counts, at any size.
2. Deobfuscation: a word of letters alone stays, lower-cased. A word with leet signs or digits
   among letters, with letters apart (`s.t.u.p.i.d`), or with runs of three or more of a letter
   becomes a lattice: each sign stands for the letters that it may hide or for nothing, each
   repeated letter for itself or for nothing. A Viterbi search under the language model picks the
   likeliest letters, in words of any length and whatever their share of signs; only words without a
   letter (numbers) stay. Single letters in a row of three or more words (`s t u p i d`) are joined first, but not
   over a gap wider than the others; they are read as one word and, by a search that may put word edges in, as several.
3. Classifier: features are restored words and their beginnings of 4 to 7 letters. From labelled
   documents, features that stand in toxic documents almost only, and in enough of them that
   aren't near copies of each other, make a lexicon; a logistic model over a document's
   count and share of lexicon words gives the score.

The labelled rows used are a bounded sample: the `sample` rows with the smallest hash of
their key (documented bound, default 6,000). Counts of the language model cover all data.

Nulls and empty texts: no word, scored like any text without lexicon words. Very long texts are
scored whole. Repeated rows: one result each, the same one; one labelled key with several texts teaches all of them. Of
labels of one key the largest counts. Ties between readings of a word go to the letter or sign read first, and a score of exactly 0.5
is toxic. No label at all, or one kind only: score is the
share of toxic labels (0 without labels). Empty table: empty result. Extra columns stay (`score_rows`) or are ignored (`toxicity`).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import checkpointed, fresh, lean, numbered, quoted, spread

#: Letters of the language model; 0 is the word edge and every other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßšž"
SIZE = 64
#: Letters that a sign may hide in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Costs in nats of a sign read as a letter, of a sign or repeated letter dropped, of a repeated letter kept.
AS_LETTER, DROP_SIGN, DROP_REPEAT, KEEP_REPEAT = 0.5, 1.5, 0.3, 1.0
MEMO, SAMPLE = 100_000, 6_000
#: Stands before letters that were apart.
JOINED = "\ufdd0"
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_RUN = re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^[^\w@$!|+€£¡*]+|[^\w@$!|+€£¡*]+$")
_APART = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_GAP = re.compile(r"[ \t]+")


def _lut() -> np.ndarray:
    """Codes of the alphabet by code point up to U+017F, capitals as small letters."""
    t = np.zeros(0x180, np.int64)
    for c, i in _CODE.items():
        t[ord(c)] = i
        if len(c.upper()) == 1 and ord(c.upper()) < 0x180:
            t[ord(c.upper())] = i
    return t


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all whole texts of column t, as an array of SIZE**3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, total = _lut(), np.zeros(SIZE**3, np.int64)
        for b in lean(batches):
            for i in range(0, b.num_rows, 200):
                text = "\n\n".join(x for x in b.column("t").slice(i, 200).to_pylist() if x)
                cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                code = np.zeros(len(cp) + 2, np.int64)
                known = cp < len(lut)
                code[1:-1] = np.where(known, lut[np.where(known, cp, 0)], 0)
                if len(cp):
                    total += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"g": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select("t").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # SIZE**3 rows at most
    out = np.zeros(SIZE**3, np.int64)
    for r in rows:
        out[r["g"]] = r["n"]
    return out


class Channel:
    """Restores words under the language model of trigram counts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = c.sum(axis=2), c.sum(axis=(0, 1))
        back = np.log((c.sum(axis=0) + 0.5 * (one + 1) / (one.sum() + SIZE)) / (c.sum(axis=(0, 2))[:, None] + 0.5))
        self.cost = -np.log((c + np.exp(back)[None]) / (two[:, :, None] + np.exp(back).sum(axis=1)[None, :, None])).astype(np.float32)

    def restore(self, word: str, edges: bool = False) -> str:
        """The likeliest letters of a lower-cased word, by Viterbi over (last two letters); with `edges`, of words with a space between.

        All states are kept: pairs of the letters that the word's own letters and signs stand for."""
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = ""
        for ch in word:
            if edges:
                for (a, b), (cost, path) in list(beam.items()):
                    total = cost + float(self.cost[a, b, 0])
                    if b and ((b, 0) not in beam or total < beam[b, 0][0]):
                        beam[b, 0] = (total, (path, " "))
            arcs: list[tuple[str, float]]
            if ch in _CODE:
                arcs = [(ch, 0.0)]
                if ch == last:
                    arcs = [(ch, KEEP_REPEAT), ("", DROP_REPEAT)]
            else:
                arcs = [(x, AS_LETTER) for x in LEET.get(ch, "")] + [("", DROP_SIGN)]
            last = ch
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in beam.items():
                for x, c in arcs:
                    if x:
                        k = _CODE[x]
                        state, total, t = (b, k), cost + c + float(self.cost[a, b, k]), (path, x)
                    else:
                        state, total, t = (a, b), cost + c, path
                    if state not in new or total < new[state][0]:
                        new[state] = (total, t)
            beam = new
        path = min(((cost + float(self.cost[a, b, 0]), t) for (a, b), (cost, t) in beam.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out)).strip()


def is_noisy(w: str) -> bool:
    """True for a lower-cased word that may hide letters: signs or digits among letters, or a letter three times in a row."""
    if _RUN.search(w) and any(c in _CODE for c in w):
        return True
    letters = sum(c in _CODE for c in w)
    foreign = sum(c.isalpha() and c not in _CODE for c in w)
    return 0 < letters < len(w) and len(w) >= 3 and letters >= foreign - 1



class Restorer:
    """Restored words of texts; each distinct word is restored once while the bounded memo lasts."""

    def __init__(self, channel: Channel):
        self.channel, self.memo = channel, {}

    def word(self, w: str) -> str:
        w = w.lower()
        if not w.isalpha():
            bare = _EDGE.sub("", w)
            # decoration at the end of words, like !! or ***, is no letter
            bare = bare.rstrip("!|+*$@€£¡_") or bare if not bare.isalpha() else bare
            w = bare
        return self.channel.restore(w) if is_noisy(w) else w

    def readings(self, w: str) -> list[str]:
        """A word restored; letters that were apart as one word, and as several with spaces between."""
        if not w.startswith(JOINED):
            return [self.word(w)]
        whole = w[1:].lower()
        return list(dict.fromkeys([self.word(whole), self.channel.restore(whole, edges=True)]))

    def __call__(self, text: str) -> list[str]:
        flat = text.replace("\n", " ")
        return (_APART.sub(joined, flat) if _APART.search(flat) else flat).split(" ")


def joined(m: re.Match) -> str:
    """Letters apart as a word, or as one for each stretch between gaps wider than the smallest."""
    if sum(c.isalpha() for c in m[0]) < 2:
        return m[0]
    least = min(len(g) for g in _GAP.findall(m[0]))
    words = re.split(r"[ \t]{%d,}" % (least + 1), m[0])
    return " ".join(JOINED + _GAP.sub("", w) for w in words)


def stems(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6, 7) if len(word) > n)]


def copy_marks(words: list[str], y: int) -> list[str]:
    """Two marks of a document, of its two smallest word hashes under either of two seeds: near copies share one."""
    import xxhash

    rare = [w for w in words if len(w) >= 7]
    rare = rare if len(rare) >= 8 else words
    return [":".join(map(str, (seed, y, *sorted(xxhash.xxh3_64_intdigest(w, seed) for w in rare)[:2]))) for seed in (1, 2)]


def first_of_copies(marks: list[tuple[str, list[str]]]) -> set[str]:
    """The documents, in order of their names, that share no mark with one before them."""
    seen: set[str] = set()
    out = set()
    for name, ms in sorted(marks):
        if not seen.intersection(ms):
            out.add(name)
        seen.update(ms)
    return out


def features_of(words: list[str]) -> set[str]:
    return {x for w in words if len(w) >= 3 for x in stems(w)}


def learn_lexicon(train: DataFrame, precision: float = 0.95, false_features: float = 0.1) -> dict[str, float]:
    """Features of toxic documents (almost) only, with a weight. `train`: name, words (restored distinct words, spaces between), y, marks.

    A feature has its full weight of 1 if so many toxic documents that aren't copies of each other hold it that, of all
    features that tell nothing, at most `false_features` are expected to pass; down to half of that evidence it has a part.
    Documents are at most a sample; tasks count features, and the driver gets the counts of those that could be in the lexicon."""
    rows = train.select("name", "y", "marks").collect()
    kept = first_of_copies([(r["name"], r["marks"]) for r in rows])
    y = {r["name"]: r["y"] for r in rows}
    n_toxic = sum(y[name] for name in kept)
    n_clean = len(kept) - n_toxic
    if not n_toxic or not n_clean:
        return {}
    spark = train.sparkSession
    names = spark.sparkContext.broadcast(kept)  # at most a sample of names

    def counter(label: int, among):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in lean(batches):
                for name, words, of in zip(*(b.column(c).to_pylist() for c in ("name", "words", "y")), strict=True):
                    if of == label and name in names.value:
                        f = features_of(words.split(" "))
                        found.update(f if among is None else f & among.value.keys())
            yield pa.RecordBatch.from_pydict({"f": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        return train.mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    ratio, surprise = n_clean / n_toxic, math.log(len(kept) / n_toxic)
    counted = checkpointed(counter(1, None))
    need = math.log(max(1, counted.count()) / false_features)
    # only features that could have half the evidence are counted in clean documents, which hold most features
    toxic = {r["f"]: r["n"] for r in counted.where(F.col("n") * surprise >= 0.5 * need).collect()}
    clean = {r["f"]: r["n"] for r in counter(0, spark.sparkContext.broadcast(toxic)).collect()}
    out = {}
    for f, c in sorted(toxic.items()):
        other = clean.get(f, 0)
        if c * ratio / (c * ratio + other + 0.5) >= precision:
            evidence = (c * surprise - math.log(math.comb(c + other, other))) / need
            if evidence >= 0.5:
                out[f] = min(1.0, evidence)
    return out


def hit_words(words: list[str], lexicon: dict[str, float]) -> float:
    return sum(max(lexicon.get(x, 0.0) for x in stems(w)) for w in words)


def doc_features(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = hits / np.maximum(n, 1)
    return np.stack([np.ones(len(hits)), np.minimum(hits, 1), np.log1p(hits), np.log1p(1000 * share)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge penalty; row i stands for n[i] documents."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (n * (p - y)) + ridge * w)
    return w


def crc_mod(key, n: int = 5):
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Scorer:
    """Weight of a text's lexicon words, and its number of words; each distinct word is restored once while the bounded memo lasts."""

    def __init__(self, channel: Channel, lexicon: dict[str, float]):
        self.r, self.lexicon, self.memo = Restorer(channel), lexicon, {}

    def weight(self, w: str) -> float:
        return max(hit_words(x.split(" "), self.lexicon) for x in self.r.readings(w))

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        hits, n, memo = [], [], self.memo
        for t in texts:
            words = self.r(t or "")
            try:
                h = sum(map(memo.__getitem__, words))
            except KeyError:
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(words):
                    if w not in memo:
                        memo[w] = self.weight(w)
                h = sum(map(memo.__getitem__, words))
            hits.append(h)
            n.append(len(words))
        return hits, n


def _training_rows(channel):
    """A batch function from name, t, y to name, words, y, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, memo = Restorer(channel.value), {}
        for b in lean(batches):
            for i in range(0, b.num_rows, 500):
                x = b.slice(i, 500)
                out, marks = [], []
                for t, y in zip(x.column("t").to_pylist(), x.column("y").to_pylist(), strict=True):
                    found: set[str] = set()
                    for w in set(r(t or "")):
                        v = memo.get(w)
                        if v is None:
                            if len(memo) > MEMO:
                                memo.clear()
                            v = memo[w] = [x for y in r.readings(w) for x in y.split(" ") if len(x) >= 3]
                        found.update(v)
                    words = sorted(found)
                    out.append(" ".join(words))
                    marks.append(copy_marks(words, y))
                arrays = [x.column("name"), pa.array(out, pa.string()), x.column("y"), pa.array(marks, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "words", "y", "marks"])

    return run


class Model:
    """All that scoring needs: the channel (broadcast), the lexicon, and the weights of the document model."""

    def __init__(self, channel, lexicon: dict[str, float], weights: np.ndarray):
        self.channel, self.lexicon, self.weights = channel, lexicon, weights

    def score(self, hits: Column, n: Column) -> Column:
        w = [float(x) for x in self.weights]
        share = hits / F.greatest(n, F.lit(1))
        z = F.lit(w[0]) + F.least(hits, F.lit(1.0)) * w[1] + F.log1p(hits) * w[2] + F.log1p(share * 1000) * w[3]
        return F.lit(1.0) / (F.exp(-z) + 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from all texts (language model) and from the labelled sample; labels of held-out documents (crc32 of the key modulo 5 is 0) are not used."""
    spark = docs.sparkSession
    src = spread(docs.select(quoted(key).alias("k"), quoted(text).alias("t")))
    channel = spark.sparkContext.broadcast(Channel(trigram_counts(src)))  # SIZE**3 numbers
    known = labels.select(quoted(key).alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y is not null").where(crc_mod(F.col("k")) != 0)
    known = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # at most `sample` keys; their texts are written once and read by each step of the fit
    taught = checkpointed(src.join(F.broadcast(known), "k").select(F.concat_ws(":", F.col("k").cast("string"), F.xxhash64("t").cast("string")).alias("name"), "t", "y"))
    train = checkpointed(taught.dropDuplicates(["name"]).mapInArrow(_training_rows(channel), "name string, words string, y int, marks array<string>"))
    lexicon = learn_lexicon(train)
    counted = taught.mapInArrow(_annotator(lambda: Scorer(channel.value, lexicon), "t", ["hits", "n"]), "name string, t string, y int, hits double, n long")
    rows = counted.groupBy("y", "hits", "n").agg(F.count(F.lit(1)).alias("c")).collect()  # at most `sample`
    y, c = np.array([r["y"] for r in rows], float), np.array([r["c"] for r in rows], float)
    if len(set(y)) == 2 and lexicon:
        x = doc_features(np.array([r["hits"] for r in rows], float), np.array([r["n"] for r in rows], float))
        return Model(channel, lexicon, fit_logistic(x, y, c))
    base = float((y * c).sum() / c.sum()) if rows else 0.0
    return Model(channel, lexicon, np.array([math.log((base + 1e-6) / (1 - base + 1e-6)), 0.0, 0.0, 0.0]))


def score_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """All columns and rows of `docs` and, behind them, score and weight of lexicon words, under the two names returned. No shuffle of documents."""
    model = fit(docs, labels, sample, key, text)
    hits, score = fresh(docs, "_hits", "_score")
    plain = spread(numbered(docs))
    schema = StructType([*plain.schema.fields, StructField("hits", DoubleType()), StructField("n", LongType())])
    out = plain.mapInArrow(_annotator(lambda: Scorer(model.channel.value, model.lexicon), f"c{docs.columns.index(text)}", ["hits", "n"]), schema)
    return out.select(*plain.columns, model.score(F.col("hits"), F.col("n")), "hits").toDF(*docs.columns, score, hits), score, hits


def _annotator(scorer, text: str, names: list[str]):
    """A batch function that puts what a scorer gives for the texts behind all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for b in lean(batches):
            for i in range(0, b.num_rows, 500):
                x = b.slice(i, 500)
                hits, n = of(x.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(hits, pa.float64()), pa.array(n, pa.int64())], names=[*x.schema.names, *names])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, score, predicted, hits."""
    out, score, hits = score_rows(docs.select(quoted(key).alias(key), quoted(text).alias(text)), labels, sample, key, text)
    held = (crc_mod(quoted(key)) == 0).alias("held_out")
    return out.select(quoted(key), held, F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"), F.col(hits).alias("hits"))
