"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

1. Fit (bounded, documented sample of the `FIT_ROWS` vectors, or as many as hold `FIT_NUMBERS` numbers, with the smallest key hash): vectors are
   centred, and `BITS` / dimension random rotations are each refined by alternating between signs and
   the best rotation (iterative quantisation), so that codes of BITS bits keep angles.
2. Rows of equal vectors are one class with its k + 1 smallest ids (no more can be among any
   nearest k), so a vector that a third of the table shares is searched, and found, once. Every class is coded.
3. Index: each code is dealt by each of its `N_SUB` substrings, (place, value) being the key. By the pigeonhole
   principle, codes within Hamming radius N_SUB * (p + 1) - 1 differ in at most p bits in some substring, so a query that
   asks for all values within p bits of its substrings meets every such code. This is an equi join: nothing is
   copied but a row for each substring, and queries to `PROBE_BITS` bits' worth of values.
4. The radius grows with p until a query's k-th best inner product is one that no vector outside the radius is expected to have:
   its angle would have to be `SIGMAS` standard deviations less than its code says, and its norm the largest.
   Each radius is tried on what one join for the largest finds. Queries whose probes would touch more than a share `CHEAP` of all codes (and more than `FEW`) don't probe.
5. Queries still open take a radius at which probes touch (nearly) every code: codes are read whole, dealt in blocks once, and the
   queries go to every block. In each block the radius is that of its `want` * k nearest codes, all of which are ranked;
   where norms differ, as many again by norm-scaled estimate.
6. All candidates are ranked by inner product in double precision on the original vectors.

Vectors that are null, zero, of another length than most have, or hold null or non-finite components take no part. Ties go to
the smaller id. Fewer candidates than k: all. Repeated ids: each row is a candidate, and a row is never its own neighbour's
twin (rows of the query's id are left out). Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted

BITS, SUB, BLOCK, FIT_ROWS, FIT_NUMBERS, WANT = 256, 16, 1 << 13, 20_000, 1 << 21, 20
N_SUB = BITS // SUB
#: Bits per substring up to which probes are tried, the share of all codes that they may touch (or how many anyway), the certainty of the stop rule.
PROBE_BITS, CHEAP, FEW, SIGMAS = 1, 0.05, 4096, 3.0
#: Queries at once in a block's task, and rows of one class from which on its answers are dealt by salt.
QUERIES, HOT, SALTS = 512, 1024, 64
CLASS = ["c1", "c2"]


class Codes:
    """Learned rotations: `code` gives packed codes as (n, BITS / 64) uint64."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, steps: int = 20, seed: int = 11):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        dim = x.shape[1]
        self.mean = x.mean(axis=0)
        x = x - self.mean
        rng = np.random.Generator(np.random.PCG64(seed))
        turns = []
        while sum(t.shape[1] for t in turns) < bits:
            r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            for _ in range(steps):
                u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (u @ vt).T
            turns.append(r)
        self.turn = np.hstack(turns)[:, :bits].astype(np.float32)

    def code(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        x = (v / np.linalg.norm(v, axis=1, keepdims=True) - self.mean).astype(np.float32)
        return np.packbits(x @ self.turn > 0, axis=1, bitorder="little").view("<u8")


def masks_within(radius: int, width: int = SUB) -> list[int]:
    """All substring differences of at most `radius` bits."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(width), r)]
    return out


def least_angle(radius: int) -> float:
    """The angle that vectors whose codes differ in more than `radius` bits are not expected to fall below."""
    share = radius / BITS
    return np.pi * max(0.0, share - SIGMAS * np.sqrt(share * (1 - share) / BITS))


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def with_codes(rows: DataFrame, codes, dim: int) -> DataFrame:
    """Adds code (BITS bits as an array of longs) to rows with a vector v."""
    schema = rows.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = codes.value.code(_matrix(b.column("v"), dim)).view("<i8")
            column = pa.ListArray.from_arrays(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, f"{schema},code:array<bigint>")


def substrings(code: Column) -> Column:
    """array<int> of a code's N_SUB substrings."""
    of = lambda x, i: F.shiftrightunsigned(x, i * SUB).bitwiseAND(F.lit((1 << SUB) - 1)).cast("int")
    return F.flatten(F.transform(code, lambda x: F.array(*[of(x, i) for i in range(64 // SUB)])))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def probed(queries: DataFrame, coded: DataFrame, p: int, n_codes: int) -> DataFrame:
    """(q1, q2, c1, c2, d): for queries that may probe at `p` bits, each with all classes within the radius N_SUB * (p + 1) - 1, and their distance d."""
    index = coded.select(*CLASS, "code", F.posexplode(substrings(F.col("code"))).alias("j", "value"))
    masks = F.array(*[F.lit(m) for m in masks_within(p)])
    asked = queries.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("code").alias("q_code"), F.posexplode(substrings(F.col("code"))).alias("j", "own"))
    asked = asked.withColumn("mask", F.explode(masks)).withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")
    # what each query's probes would touch, from the sizes of buckets
    sizes = index.groupBy("j", "value").agg(F.count(F.lit(1)).alias("n"))
    touched = asked.select("q1", "q2", "j", "value").join(sizes, ["j", "value"]).groupBy("q1", "q2").agg(F.sum("n").alias("n"))
    may = touched.where(F.col("n") <= max(FEW, CHEAP * n_codes)).select("q1", "q2")
    radius = N_SUB * (p + 1) - 1
    pairs = asked.join(may, ["q1", "q2"], "left_semi").join(index, ["j", "value"]).withColumn("d", distance(F.col("q_code"), F.col("code")))
    return pairs.where(F.col("d") <= radius).select("q1", "q2", *CLASS, "d").distinct()


def scored(pairs: DataFrame, queries: DataFrame, coded: DataFrame, dim: int) -> DataFrame:
    """(q1, q2, d, vec_id, m, score): the ids of pairs, how often they stand, and the inner product."""
    q = queries.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("v").alias("qv"))
    both = pairs.join(q, ["q1", "q2"]).join(coded.select(*CLASS, "v", F.arrays_zip("ids", "times").alias("ids")), CLASS).select("q1", "q2", "d", "ids", "qv", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = (_matrix(b.column("qv"), dim) * _matrix(b.column("v"), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("q1"), b.column("q2"), b.column("d"), b.column("ids"), pa.array(score, pa.float64())], names=["q1", "q2", "d", "ids", "score"])

    out = both.mapInArrow(run, "q1 long, q2 long, d int, ids array<struct<ids:long,times:int>>, score double").withColumn("x", F.explode("ids"))
    return out.select("q1", "q2", "d", F.col("x.ids").alias("vec_id"), F.col("x.times").alias("m"), "score")


class Block:
    """Codes of a block, with all that ranking needs."""

    def __init__(self, vectors: np.ndarray, code: np.ndarray):
        self.vectors, self.signs = vectors, _signs(code)
        self.norms = np.linalg.norm(vectors, axis=1)
        self.uneven = bool(np.ptp(self.norms) > 1e-3 * self.norms.max())
        self.cosines = np.cos(np.pi * np.arange(BITS + 1) / BITS).astype(np.float32)

    def nearest(self, queries: np.ndarray, code: np.ndarray, want: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of the best `k` of the block; ties of the k-th score all stay."""
        want = min(want, len(self.vectors))
        far = ((BITS - _signs(code) @ self.signs.T) / 2).astype(np.int16)
        radius = np.partition(far, want - 1, axis=1)[:, want - 1]
        for row, r, q in zip(far, radius, queries, strict=True):
            take = row <= r
            if self.uneven:
                guess = self.cosines[row] * self.norms
                take |= guess >= np.partition(guess, len(guess) - want)[len(guess) - want]
            at = np.flatnonzero(take)
            score = (self.vectors[at] * q).sum(axis=1)
            if len(at) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[keep], score[keep]
            yield at, score


def scanned(queries: DataFrame, coded: DataFrame, n_codes: int, dim: int, k: int, want: int) -> DataFrame:
    """(q1, q2, vec_id, m, score) of the best k of each block of codes for each query. Codes are dealt once; queries go to each block."""
    n_blocks = max(1, -(-n_codes // BLOCK))
    none = F.lit(None)
    left = coded.select(F.pmod("c1", F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("role"), *CLASS, "v", "code", "ids", "times")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("role"), *CLASS, "v", "code", none.cast("array<bigint>").alias("ids"), none.cast("array<int>").alias("times"))
    rows = left.unionByName(right).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "role")
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("vec_id", pa.int64()), ("m", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, ids, times, at = None, [], [], None

        def answers(b: pa.RecordBatch) -> pa.RecordBatch:
            q1, q2 = b.column("c1").to_numpy(), b.column("c2").to_numpy()
            out: list[np.ndarray] = []
            vec, m, score = [], [], []
            for i, (places, scores) in enumerate(block.nearest(_matrix(b.column("v"), dim), _codes(b.column("code")), want * k, k)):
                lists = [ids[p] for p in places.tolist()]
                vec += [x for one in lists for x in one]
                m += [x for p in places.tolist() for x in times[p]]
                sizes = [len(one) for one in lists]
                score.append(np.repeat(scores, sizes))
                out.append(np.full(sum(sizes), i))
            take = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(q1[take]), pa.array(q2[take]), pa.array(vec, pa.int64()), pa.array(m, pa.int32()), pa.array(np.concatenate(score))], schema=schema)

        for whole in batches:
            start = 0
            blocks, roles = whole.column("block").to_numpy(), whole.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
            for end in [*cuts.tolist(), whole.num_rows]:
                b, start = whole.slice(start, end - start), end
                if not b.num_rows:
                    continue
                number, role = int(b.column("block")[0].as_py()), int(b.column("role")[0].as_py())
                if number != at:
                    at, held, block = number, [], None
                if role == 0:
                    held.append(b)
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(np.vstack([_matrix(h.column("v"), dim) for h in held]), np.vstack([_codes(h.column("code")) for h in held]))
                    ids, times = ([x for h in held for x in h.column(c).to_pylist()] for c in ("ids", "times"))
                    held = []
                for i in range(0, b.num_rows, QUERIES):
                    yield answers(b.slice(i, QUERIES))

    return rows.mapInArrow(run, "q1 long, q2 long, vec_id long, m int, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k + 1 of each query class: rank n, ties to the smaller id."""
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, want: int = WANT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, radius of the k nearest of each row whose key is divisible by `every`; `radius` is that of the probes that
    answered the query (null where it took codes whole)."""
    rows = vectors.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v")).where("id is not null").where(valid(F.col("v")))
    spark = vectors.sparkSession
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, radius int")
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(max(dim, min(FIT_ROWS, FIT_NUMBERS // dim))).select("v").collect()
    codes = spark.sparkContext.broadcast(Codes(np.array([r["v"] for r in sample])))  # dim * BITS numbers

    # classes of equal vectors under a 128-bit name; the first k + 1 ids of each, with how often they stand (others can't be among any k nearest)
    rows = rows.select("id", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("c2"), "v")
    by_class = Window.partitionBy(*CLASS).orderBy("id")
    ids = rows.groupBy(*CLASS, "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m"))
    ids = ids.withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1)
    ids = ids.groupBy(*CLASS).agg(F.sort_array(F.collect_list(F.struct("id", "m"))).alias("x")).select(*CLASS, F.col("x.id").alias("ids"), F.col("x.m").alias("times"))
    kept = rows.groupBy(*CLASS).agg(F.first("v").alias("v")).join(ids, CLASS)
    coded = checkpointed(with_codes(kept, codes, dim))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", *CLASS)
    wanted = asked.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_asked"))
    queries = checkpointed(coded.select(*CLASS, "v", "code").join(wanted, CLASS))
    n_codes = coded.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = coded.agg(F.max(norm)).first()[0]

    done, todo = [], queries
    # one join with the index for the largest radius that is probed; the smaller ones are parts of what it finds
    met = checkpointed(scored(probed(queries, coded, PROBE_BITS, n_codes), queries, coded, dim))
    for p in range(PROBE_BITS + 1):
        radius = N_SUB * (p + 1) - 1
        top = best_of(met.where(F.col("d") <= radius).drop("d"), k)
        last = top.where(F.col("n") == k + 1).select(F.col("q1").alias("c1"), F.col("q2").alias("c2"), F.col("score").alias("last"))
        bound = norm * float(longest * np.cos(least_angle(radius)))
        sure = checkpointed(todo.join(last, CLASS).where(F.col("last") >= bound).select(F.col("c1").alias("q1"), F.col("c2").alias("q2")))
        if not sure.isEmpty():
            done.append(top.join(sure, ["q1", "q2"], "left_semi").withColumn("radius", F.lit(radius)))
            todo = checkpointed(todo.join(sure, (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("q2")), "left_anti"))
    top = best_of(scanned(todo, coded, n_codes, dim, k + 1, want), k).withColumn("radius", F.lit(None).cast("int"))
    for part in done:
        top = top.unionByName(part)
    # one row per class; every query of the class gets its own list, without itself
    near = F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "m"))).alias("near")
    lists = top.groupBy("q1", "q2").agg(near, F.max("radius").alias("radius")).withColumnsRenamed({"q1": "c1", "q2": "c2"})
    lists = lists.join(queries.select(*CLASS, "n_asked"), CLASS)
    # a class that many queries share is dealt by salt
    hot = queries.where(F.col("n_asked") >= HOT).select(*CLASS, F.lit(True).alias("hot"))
    few = hot.limit(100_001).count() <= 100_000
    asked = asked.join(F.broadcast(hot) if few else hot, CLASS, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n_asked") >= HOT, SALTS - 1).otherwise(0).cast("long")))).drop("n_asked")
    answers = asked.join(lists, [*CLASS, "salt"]).select(F.col("id").alias("query_id"), F.filter("near", lambda s: s["vec_id"] != F.col("id")).alias("near"), "radius")
    answers = answers.withColumn("near", F.flatten(F.transform("near", lambda s: F.array_repeat(s, s["m"]))))
    answers = answers.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "s"), "radius")
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"), "radius")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _codes(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, BITS // 64)


def _signs(code: np.ndarray) -> np.ndarray:
    """Bits of codes as -1 and 1."""
    bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1
