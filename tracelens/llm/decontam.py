"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the benchmark's words (runs of letters and digits, lower case). Their document
   frequencies are counted over all documents; terms of more than `COMMON` of them are stop words.
2. TF-IDF passages of the documents (`FIT` strides of `STRIDE` words) in `DIMS` signed hash
   dimensions go through a single-pass randomised SVD: each task sums A'(A Omega) over its
   passages, sums of tasks are added up in a tree, and the driver factors the DIMS * RANK result.
3. Candidates: at every stride of every document, the window of `FIT` strides with a stride on either side, if it holds
   as many of an item's terms as step 4 can do with at the least (of all its words, where terms are too few to tell). Windows are
   found by the item's rarest terms: one without any of as many as could be missing can't hold enough of the rest, so windows and items are
   never paired otherwise. Nothing that step 4 accepts in it is left out. The cosine given is the best of the projections of 1, 2 and 4 strides there; it decides nothing.
4. Check: the longest common subsequence of words of the item and the window. A share of `SURE` of the item's words, or of `LCS` of its words and of its terms alone, is a copy; a share of `PARA` is a
   paraphrase if the window also holds the item's answer: the last `ANSWER` terms of its last sentence, in order.

Items of over `PART` words are looked for in parts, and are found if a part is. Benchmarks are read in blocks of `BLOCK_ITEMS` items or `BLOCK_CHARS` characters (bounded on each executor); documents
are read once for a block and step. What tasks send is DIMS * RANK numbers and one count a term.

Nulls and empty texts on either side match nothing. Items with no term but stop words are compared
by all their words as terms. Very long texts are scanned whole. Repeated rows: a result row each; a null key gives
rows with a null key. Repeated items: each its own. Empty tables: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, numbered, quoted, spread

STRIDE, FIT, DIMS, RANK = 24, 4, 1024, 96
COMMON, SURE, LCS, PARA, ANSWER = 0.1, 0.8, 0.7, 0.5, 3
BLOCK_ITEMS, BLOCK_CHARS, ROWS, SLICE_BYTES, PART, WINDOWS = 4096, 1 << 23, 400, 1 << 21, 64, 20_000
_QUOTES = dict.fromkeys("«»„“”’‘‚–—…¿¡", " ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _ODD)), np.cumprod(np.full(n, _INVERSE))


class Words:
    """The words of some texts, lower-cased, as arrays: runs of letters and digits with their text, place, bytes and hash.

    A word's hash is the sum of its bytes times powers of an odd number modulo 2**64, from running sums, so no word is
    touched one by one. Hashes only find terms; matches are confirmed on the words themselves."""

    def __init__(self, texts: list[str | None]):
        raw = []
        for t in texts:
            t = (t or "").lower()
            if not t.isascii():
                for q in _QUOTES:
                    if q in t:
                        t = t.replace(q, " ")
            raw.append(t.encode("utf-8", "surrogatepass"))
        self.bytes = b" ".join([*raw, b""])
        data = np.frombuffer(self.bytes, np.uint8)
        inside = _IN_WORD[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        up, down = _powers(1 << max(16, len(data).bit_length()))
        with np.errstate(over="ignore"):
            run = np.cumsum(data * up[: len(data)])
            before = np.where(self.start > 0, run[np.maximum(self.start, 1) - 1], np.uint64(0))
            self.hash = (run[self.end - 1] - before) * down[self.start]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text, then the count of all
        self.place = np.arange(len(self.doc)) - self.first[self.doc]

    def of(self, lo: int, hi: int) -> list[bytes]:
        return [self.bytes[a:b] for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def tokens(text: str | None) -> list[bytes]:
    w = Words([text])
    return w.of(0, len(w.doc))


class Terms:
    """Term number of words by hash, -1 for words that are none."""

    def __init__(self, words: list[bytes]):
        hashes = Words([b" ".join(words).decode("utf-8", "surrogatepass")]).hash if words else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def of(self, w: Words) -> np.ndarray:
        out = np.full(len(w.hash), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(w.hash >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.sorted):
            h = w.hash[maybe]
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[at] == h
            out[maybe[hit]] = self.number[at[hit]]
        return out


class Model:
    """What the scan needs of a block of items: terms, their weights, the projection, the items."""

    def __init__(self, items: list[tuple[int, str]]):
        # long items are looked for in even parts of at most PART words
        self.items = [(i, list(map(bytes, part))) for i, t in items for w in [tokens(t)] if w for part in np.array_split(np.array(w, object), -(-len(w) // PART))]
        self.vocab = {w: n for n, w in enumerate(sorted({x for _, ws in self.items for x in ws}))}
        rng = np.random.Generator(np.random.PCG64(7))
        n = len(self.vocab)
        self.lookup = Terms(list(self.vocab))
        self.bucket, self.sign = rng.integers(0, DIMS, n), rng.choice([-1.0, 1.0], n)
        self.omega = rng.standard_normal((DIMS, RANK)).astype(np.float32)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.stop = df > COMMON * n_docs
        self.idf = np.where(self.stop, 0.0, np.log((n_docs + 1) / (df + 1)) + 1e-3)
        for _, ws in self.items:  # an item of stop words alone keeps them
            t = [self.vocab[w] for w in ws]
            if self.stop[t].all():
                self.idf[t] = np.maximum(self.idf[t], 0.1)

    def project(self, z: np.ndarray) -> None:
        """Right singular vectors from Z = A'A Omega (single pass, positive semi-definite), then all terms and items in them."""
        b = self.omega.T.astype(np.float64) @ z
        shift = 1e-6 * max(np.trace(b) / RANK, 1e-9)
        w, q = np.linalg.eigh((b + b.T) / 2 + shift * np.eye(RANK))
        half = z @ (q / np.sqrt(np.maximum(w, shift)))
        u, _, _ = np.linalg.svd(half, full_matrices=False)
        self.basis = u
        terms = (self.idf * self.sign)[:, None] * u[self.bucket]
        self.terms = np.vstack([terms, np.zeros((1, RANK))]).astype(np.float32)
        rows = [self.terms[[self.vocab[w] for w in ws]].sum(axis=0) for _, ws in self.items]
        m = np.array(rows, np.float32).reshape(len(self.items), RANK)
        self.matrix = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        self.rare = [[w for w in ws if self.idf[self.vocab[w]] > 0] for _, ws in self.items]
        # the terms (or words) of an item by which windows are found, each with its count in the item, and how many a match has at the least
        counts: list[tuple[int, int, int]] = []
        rarest: list[tuple[int, int]] = []
        self.need = np.zeros(len(self.items))
        for n, ((_, ws), rare) in enumerate(zip(self.items, self.rare, strict=True)):
            least = min(PARA * len(rare), len(rare) - (1 - SURE) * len(ws))
            by, need = (rare, least) if least > 1 else (ws, PARA * len(ws))
            self.need[n] = need - 1e-6  # of rounding
            of = Counter(self.vocab[w] for w in by)
            counts += [(n, t, c) for t, c in of.items()]
            # a window without any of the rarest terms, up to here, can't hold enough of the others
            left = len(by)
            for t in sorted(of, key=lambda t: (-self.idf[t], t)):
                if left < self.need[n]:
                    break
                rarest.append((t, n))
                left -= of[t]
        table = np.array(sorted(counts), np.int64).reshape(-1, 3)
        self.held, self.held_count = table[:, 0] * len(self.vocab) + table[:, 1], table[:, 2]
        of_term, self.post_item = np.array(sorted(rarest), np.int64).reshape(-1, 2).T
        self.post_first = np.searchsorted(of_term, np.arange(len(self.vocab) + 1))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each run behind each other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a machine word's worth of bits at a time."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = at.get(w, 0)
        if m:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def answer_of(words: list[bytes], rare: list[bytes], original: str) -> list[bytes]:
    """The last ANSWER terms of the last sentence that has a term."""
    keep = set(rare)
    for sentence in reversed(original.replace("\n", ". ").split(". ")):
        found = [w for w in tokens(sentence) if w in keep]
        if found:
            return found[-ANSWER:]
    return words[-ANSWER:]


def in_order(need: list[bytes], words: list[bytes]) -> bool:
    it = iter(words)
    return all(w in it for w in need)


def _sum_rows(df: DataFrame, size: int) -> np.ndarray:
    """Sum of float64 arrays (column z, one per task, keyed by part), added up in tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for b in lean(batches):
            for z in b.column("z"):
                total += np.frombuffer(z.as_buffer(), np.float64)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_pydict({"z": pa.array([total.tobytes()], pa.binary())})

    rows = df.repartition(8, "part").sortWithinPartitions("part").select("z").mapInArrow(add, "z binary").collect()  # at most 8
    return sum((np.frombuffer(r["z"]) for r in rows), np.zeros(size))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches in slices of at most ROWS rows and about SLICE_BYTES, with their words."""
    for b in lean(batches):
        i = 0
        while i < b.num_rows:
            n, size = 0, 0
            texts = []
            while i + n < b.num_rows and n < ROWS and size < SLICE_BYTES:
                t = b.column(column)[i + n].as_py()
                texts.append(t)
                size += len(t or "")
                n += 1
            yield b.slice(i, n), Words(texts)
            i += n


def _frequencies(src: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    shared, n_terms = src.sparkSession.sparkContext.broadcast(model.lookup), len(model.vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        df = np.zeros(n_terms + 1, np.float64)
        for x, w in _slices(batches, "t"):
            t = shared.value.of(w)
            hit = t >= 0
            both = np.unique(w.doc[hit] * n_terms + t[hit])
            df[:-1] += np.bincount(both % n_terms, minlength=n_terms) if n_terms else 0
            df[-1] += x.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "z": pa.array([df.tobytes()], pa.binary())})

    total = _sum_rows(src.select("t").mapInArrow(count, "part int, z binary"), n_terms + 1)
    return total[:-1], int(total[-1])


def _range_finder(src: DataFrame, model) -> np.ndarray:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = model.value
        z, weight, block = np.zeros((DIMS, RANK)), m.idf * m.sign, 512
        for _, w in _slices(batches, "t"):
            t = m.lookup.of(w)
            at = np.flatnonzero(t >= 0)
            at = at[weight[t[at]] != 0]
            # passages that hold a term: words of one text and FIT strides
            passage = w.doc[at] * (1 << 32) + w.place[at] // (STRIDE * FIT)
            _, row = np.unique(passage, return_inverse=True)
            term = t[at]
            for first in range(0, int(row[-1]) + 1 if len(row) else 0, block):
                lo, hi = np.searchsorted(row, [first, first + block])
                a = np.bincount((row[lo:hi] - first) * DIMS + m.bucket[term[lo:hi]], weight[term[lo:hi]], minlength=block * DIMS).reshape(block, DIMS).astype(np.float32)
                z += a.T @ (a @ m.omega)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "z": pa.array([z.tobytes()], pa.binary())})

    return _sum_rows(src.select("t").mapInArrow(sketch, "part int, z binary"), DIMS * RANK).reshape(DIMS, RANK)


class Scanner:
    """Finds the items of a model in texts."""

    def __init__(self, model: Model, texts: dict[int, str]):
        self.m = model
        self.bags = [Counter(model.vocab[x] for x in ws) for _, ws in model.items]
        self.answers = [answer_of(ws, rare, texts[i]) for (i, ws), rare in zip(model.items, model.rare, strict=True)]

    def cosine(self, item: int, terms: np.ndarray) -> float:
        """The best cosine of the item and the first 1, 2 or 4 strides of a window's terms."""
        run = [self.m.terms[terms[: n * STRIDE]].sum(axis=0) for n in (1, 2, FIT)]
        return max(float(v @ self.m.matrix[item]) / max(float(np.linalg.norm(v)), 1e-12) for v in run)

    def check(self, item: int, terms: np.ndarray, w: Words, lo: int, hi: int) -> tuple[float, bool, str] | None:
        ws, rare = self.m.items[item][1], self.m.rare[item]
        # no sense in words where too few of the window's are the item's
        bag = self.bags[item]
        have = Counter(t for t in terms.tolist() if t in bag)
        if sum(min(c, bag[t]) for t, c in have.items()) < PARA * len(ws):
            return None
        words = w.of(lo, hi)
        share = lcs_length(ws, words) / len(ws)
        if share < PARA:
            return None
        keep = set(rare)
        rare_share = lcs_length(rare, [w for w in words if w in keep]) / max(1, len(rare))
        answered = in_order(self.answers[item], words)
        if share >= SURE or min(share, rare_share) >= LCS:
            return share, answered, "copy"
        return (share, answered, "paraphrase") if rare_share >= PARA and answered else None

    def candidates(self, where: np.ndarray, term: np.ndarray, real: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stride, item) of all windows that hold as many of an item's terms as a match does at the least, in turn.

        `where` and `term`: the benchmark's terms in each stride, once each, in order; `real`: strides that are one. Windows are looked for by items' rarest terms
        in them, without which no window can hold enough; the others are counted in those windows only."""
        m, n_items = self.m, len(self.m.items)
        size = m.post_first[term + 1] - m.post_first[term]
        seeds = np.unique(np.repeat(where, size) * n_items + m.post_item[_runs(m.post_first[term], size)])
        windows = np.unique((seeds[:, None] - np.arange(-1, FIT + 1)[None, :] * n_items).ravel())
        stride = windows // n_items
        windows = windows[(stride >= 0) & (stride < len(real))]
        windows = windows[real[windows // n_items]]
        for first in range(0, len(windows), WINDOWS):
            own = windows[first : first + WINDOWS]
            # each window's strides with the item, and how many of its terms they hold
            cells = own[:, None] + np.arange(-1, FIT + 1)[None, :] * n_items
            pair, at = np.unique(cells.ravel(), return_inverse=True)
            lo, hi = np.searchsorted(where, pair // n_items), np.searchsorted(where, pair // n_items + 1)
            owner = np.repeat(np.arange(len(pair)), hi - lo)
            key = pair[owner] % n_items * len(m.vocab) + term[_runs(lo, hi - lo)]
            place = np.minimum(np.searchsorted(m.held, key), len(m.held) - 1)
            hit = m.held[place] == key
            count = np.bincount(owner[hit], m.held_count[place[hit]], minlength=len(pair))[at].reshape(cells.shape).sum(axis=1)
            enough = own[count >= m.need[own % n_items]]
            yield enough // n_items, enough % n_items

    def __call__(self, w: Words) -> list[tuple[int, int, float, float, bool, str]]:
        """(place of the text, item, cosine, share, answered, kind) of each item found in each text."""
        m, pad = self.m, FIT + 2
        terms = m.lookup.of(w)
        at = np.flatnonzero(terms >= 0)
        if not len(at) or not m.items:
            return []
        # strides of all texts behind each other, with some empty ones between texts and before the first
        own = -(-np.diff(w.first) // STRIDE)
        base = np.cumsum(own + pad) - own
        # each term once a stride
        where, term = np.divmod(np.unique((base[w.doc[at]] + w.place[at] // STRIDE) * len(m.vocab) + terms[at]), len(m.vocab))
        real = np.zeros(int(base[-1] + own[-1]), bool)
        real[_runs(base, own)] = True
        found: dict[tuple[int, int], tuple] = {}
        for p, item in self.candidates(where, term, real):
            doc = np.searchsorted(base, p, side="right") - 1
            s = p - base[doc]
            los, his = w.first[doc] + np.maximum(0, (s - 1) * STRIDE), np.minimum(w.first[doc + 1], w.first[doc] + (s + FIT + 1) * STRIDE)
            for n in range(len(p)):
                key = (int(doc[n]), int(item[n]))
                if key in found and found[key][3] == "copy":
                    continue
                hit = self.check(key[1], terms[los[n] : his[n]], w, int(los[n]), int(his[n]))
                if hit and (key not in found or hit[0] > found[key][1]):
                    found[key] = (self.cosine(key[1], terms[w.first[doc[n]] + s[n] * STRIDE : his[n]]), *hit)
        best: dict[tuple[int, int], tuple] = {}
        for (d, n), v in sorted(found.items()):
            key = (d, m.items[n][0])
            if key not in best or v[1] > best[key][1]:
                best[key] = v
        return [(d, i, *v) for (d, i), v in best.items()]


def _models(docs: DataFrame, bench: DataFrame, text: str, item_key: str, item_text: str) -> Iterator:
    """A broadcast (model, item texts, item keys) for each block of benchmark items."""
    spark = docs.sparkSession
    src = spread(docs.select(quoted(text).alias("t")))
    items = bench.select(F.col(f"`{item_key}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null").orderBy("i", "t")

    def fitted(block: list[tuple[int, str]]):
        model = Model(list(enumerate(t for _, t in block)))
        model.weigh(*_frequencies(src, model))
        model.project(_range_finder(src, spark.sparkContext.broadcast(model)))
        return spark.sparkContext.broadcast((model, {n: t for n, (_, t) in enumerate(block)}, [i for i, _ in block]))

    block: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(block) == BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield fitted(block)
            block, size = [], 0
    if block:
        yield fitted(block)


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id, cosine, lcs_share, answered, kind."""
    src = spread(docs.select(quoted(key).alias("k"), quoted(text).alias("t")))
    schema = f"k {src.schema['k'].dataType.simpleString()}, item_id long, cosine double, lcs_share double, answered boolean, kind string"

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, texts, names = shared.value
            s = Scanner(m, texts)
            for x, w in _slices(batches, "t"):
                hits = s(w)
                if hits:
                    d, item, cos, share, answered, how = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [x.column("k").take(pa.array(d)), pa.array([names[j] for j in item], pa.int64()), pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(answered, pa.bool_()), pa.array(how, pa.string())],
                        names=["k", "item_id", "cosine", "lcs_share", "answered", "kind"],
                    )

        return find

    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _models(docs, bench, text, item_key, item_text):
        out = out.unionByName(src.mapInArrow(finder(shared), schema))
    return out.withColumnRenamed("k", key)


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns. No shuffle of documents."""

    def cleaner(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, texts, _ = shared.value
            s = Scanner(m, texts)
            for x, w in _slices(batches, place):
                keep = np.ones(x.num_rows, bool)
                keep[[h[0] for h in s(w)]] = False
                yield x.filter(pa.array(keep))

        return clean

    out, place = spread(numbered(docs)), f"c{docs.columns.index(text)}"
    schema = out.schema
    for shared in _models(docs, bench, text, item_key, item_text):
        out = out.mapInArrow(cleaner(shared), schema)
    return out.toDF(*docs.columns)
