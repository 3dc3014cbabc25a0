"""Near duplicates by b-bit MinHash.

1. Shingles: words (A-Z lower-cased) in runs of five, as a set of 64-bit hashes. Documents of
   equal sets (128-bit digest and size) are one class, represented by the smallest key; all that
   follows is about representatives, so copies cost nothing further.
2. Signatures: `BANDS` * `ROWS` minima per set (and a few more for the estimate). Each band's minima make a bucket key (64 bits);
   of every minimum only the `BITS` low bits are kept, packed.
3. Candidates: representatives of the same bucket are linked to the bucket's smallest key,
   never with each other. A pair's similarity is estimated from the packed signatures by bit
   counts, corrected for chance collisions of `BITS` bits; pairs that even five standard
   errors above the estimate miss the threshold go.
4. Confirmation: intersection and union of the full shingle sets.
5. Components by alternating large and small stars over the links (tables, no driver).
6. Representatives whose buckets have the same smallest key are a group. Groups that now hold more than one
   component are looked through for links across them: a group is dealt in blocks, large components apart, and a task compares the
   signatures of two blocks by bit counts. Texts follow only of members that meet a possible partner of another component; such
   pairs are confirmed on full sets, likeliest first. A link joins the two components for the rest of the task, and only
   such links come out: fewer than the task has rows. Then 5 again, on components.

A pair at a threshold of 80 of 100 shares no bucket with a probability below 3e-7, at 85 of 100
below 3e-10 (38 bands of 5); farther copies of a group find each other through more than one path.

Nulls and empty texts have an empty set, and are linked with nothing (not even with each
other). A null key is kept with a null component. Very long texts are whole sets, hashed in
slices. Repeated rows of one key and text: one class, each row kept in the result. Rows of one key with different
texts count as one document, with the text whose 64-bit hash is smallest. Empty table: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drop_path, lean, mix64, quoted, shared_path, shingle_set, spread, word_list, WordHash

BANDS, ROWS, BITS, SLICE = 38, 5, 4, 2048
BLOCK, SALTS = 128, 32
_SIZE = BANDS * ROWS + 63 & ~63  # whole words of bits
_rng = np.random.Generator(np.random.PCG64(20240607))
_MUL = _rng.integers(0, 1 << 32, _SIZE, np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, _SIZE, np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The `_SIZE` minima of a set of 64-bit hashes."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(_SIZE, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), SLICE):
            h = low[i : i + SLICE, None] * _MUL
            h += _ADD
            np.minimum(best, h.min(axis=0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64)
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return acc.view(np.int64)


def packed(m: np.ndarray) -> bytes:
    """The low BITS bits of each minimum (after a mix, as low bits of products are weak), bit plane by bit plane."""
    low = mix64(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    planes = (low[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def equal_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the kept values are equal; a and b are arrays of packed signatures as (..., BITS, words of 64)."""
    diff = np.bitwise_or.reduce(a ^ b, axis=-2)
    return _SIZE - np.bitwise_count(diff).sum(axis=-1, dtype=np.int64)


def unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), BITS, _SIZE // 64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity corrected for values that are equal by chance, with the chance 2**-BITS."""
    chance = 2.0**-BITS
    return (equal / _SIZE - chance) / (1 - chance)


def least_equal(threshold: float) -> int:
    """Fewest equal values with which a pair may still reach the threshold: five standard errors below the mean."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return int(np.floor(_SIZE * p - 5 * np.sqrt(_SIZE * p * (1 - p))))


def sets_of(width: int):
    hash_words = WordHash()
    return lambda text: shingle_set(hash_words(word_list(text)), width)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """k, th (hash of the text), n_shingles, digest (of the set), sig, bands; the last three null for empty sets. Input: k, t."""
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        to_set = sets_of(width)
        for b in lean(batches):
            for i in range(0, b.num_rows, 1000):
                x = b.slice(i, 1000)
                n, digest, sig, bands = [], [], [], []
                for t in x.column("t"):
                    s = to_set(t.as_py())
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sig.append(packed(m))
                        bands.append(band_keys(m))
                    else:
                        for c in (digest, sig, bands):
                            c.append(None)
                yield pa.RecordBatch.from_arrays([x.column("k"), x.column("th"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return docs.select("k", F.xxhash64("t").alias("th"), "t").mapInArrow(run, "k long, th long, n_shingles long, digest binary, sig binary, bands array<long>")


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that may reach the threshold by their signatures."""
    sig = reps.select("k", "sig", "n_shingles")
    both = pairs.join(sig.select(F.col("k").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a").join(sig.select(F.col("k").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
    # sets whose sizes differ too much can't be that similar
    both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9))
    least = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            if b.num_rows:
                eq = equal_counts(unpack(b.column("sa").to_pylist()), unpack(b.column("sb").to_pylist()))
                keep = pa.array(eq >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, keys: DataFrame) -> str:
    """A table (k, t) of the texts of some keys, written once: all texts are dealt by key a single time, and copies of a key fall away."""
    path = shared_path(docs.sparkSession, "texts")
    docs.join(keys.distinct(), "k", "left_semi").groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t")).write.parquet(path)
    return path


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int, salts: int = 64) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold. Each pair's task gets b's text once for up to a block of a's.

    Pairs of one b are dealt over salts, and its text goes to the salts that its pairs are in."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    left = dealt.join(texts.select(F.col("k").alias("a"), F.col("t").alias("t")), "a").select("b", "salt", "a", "t")
    right = dealt.select("b", "salt").distinct().join(texts.select(F.col("k").alias("b"), F.col("t").alias("t")), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "t")
    rows = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_set = sets_of(width)
        at, mine = None, np.empty(0, np.uint64)
        for batch in lean(batches):
            for i in range(0, batch.num_rows, 500):
                x = batch.slice(i, 500)
                found = ([], [])
                for b, salt, a, t in zip(*(x.column(c).to_pylist() for c in ("b", "salt", "a", "t")), strict=True):
                    s = to_set(t)
                    if a is None:
                        at, mine = (b, salt), s
                        continue
                    assert at == (b, salt)
                    common = len(np.intersect1d(s, mine, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(mine) - common):
                        found[0].append(a)
                        found[1].append(b)
                yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return checkpointed(rows.mapInArrow(run, "a long, b long"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """k, c: the smallest key that each linked key reaches. Large star, small star, until no link changes."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        # large star: link all larger neighbours of a key to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link a key and its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        # all stars: no centre is a leaf; then nothing changes any more
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("c"))


def near_pairs(ks: np.ndarray, cs: np.ndarray, ns: np.ndarray, blocks: np.ndarray, sigs: np.ndarray, i: int, j: int, threshold: float) -> list[tuple[int, int, int]]:
    """(equal values, place, place) of pairs of blocks i and j, of different components, that may reach the threshold by their signatures."""
    least, first, second = least_equal(threshold), np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    near: list[tuple[int, int, int]] = []
    for p in first:
        q = second[(cs[second] != cs[p]) & (np.minimum(ns[second], ns[p]) >= np.maximum(ns[second], ns[p]) * (threshold - 1e-9))]
        q = q[ks[q] < ks[p]] if i == j else q
        if len(q):
            eq = equal_counts(sigs[q], sigs[p])
            near += [(int(e), int(p), int(x)) for e, x in zip(eq[eq >= least], q[eq >= least], strict=True)]
    return near


def block_rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each (g, i, j) in turn, as tuples of the columns, of which these are the first."""
    held: list[tuple] = []
    for b in lean(batches):
        for start in range(0, b.num_rows, 500):
            x = b.slice(start, 500)
            for r in zip(*(x.column(c).to_pylist() for c in columns), strict=True):
                if held and r[:3] != held[0][:3]:
                    yield held
                    held = []
                held.append(r)
    if held:
        yield held


def groups_in_blocks(placed: DataFrame) -> DataFrame:
    """g, small, blocks, large: the groups of more than one component (and two members), with how their members are cut into blocks.

    A component of `BLOCK` members or more has blocks of its own, `n` from number `first` on (`large` has a struct for each);
    members of the others share the first `small` blocks."""
    sizes = checkpointed(placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")))
    mixed = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("n_components"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).alias("rest"))
    mixed = mixed.where("n_components > 1 and n > 2").select("g", F.ceil(F.col("rest") / BLOCK).cast("int").alias("small"))
    # a group has at most one large component for each BLOCK of its members
    large = sizes.where(F.col("n") >= BLOCK).join(mixed, "g").withColumn("n", F.ceil(F.col("n") / BLOCK).cast("int"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    large = large.withColumn("first", (F.col("small") + F.coalesce(before, F.lit(0))).cast("int"))
    large = large.groupBy("g").agg(F.collect_list(F.struct("c", "first", "n")).alias("large"))
    none = F.array().cast("array<struct<c:bigint,first:int,n:int>>")
    out = mixed.join(large, "g", "left").withColumn("large", F.coalesce("large", none))
    return out.withColumn("blocks", F.col("small") + F.aggregate("large", F.lit(0), lambda x, y: x + y["n"]))


def by_pairs(rows: DataFrame) -> DataFrame:
    """Rows dealt by (g, i, j): the pairs of a group's blocks go to tasks in turn, so that a large group fills them evenly."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.pmod(F.xxhash64("g"), F.lit(n)) + F.col("j").cast("long") * F.col("blocks") + F.col("i"), F.lit(n)).cast("int")
    return rows.repartitionById(n, turn).sortWithinPartitions("g", "i", "j")


def meeting(members: DataFrame, threshold: float) -> DataFrame:
    """g, i, j, k, c, n_shingles, sig, block, blocks: the members that meet one of another component that they may be linked with, for each pair of blocks.

    `members`: g, k, c, n_shingles, sig, and the group's small, blocks, large. A task compares the signatures of two blocks; texts aren't needed
    yet. Blocks of one and the same large component don't meet."""
    own = F.get(F.filter("large", lambda x: x["c"] == F.col("c")), F.lit(0))
    dealt = members.withColumn("own", own).drop("large")
    block = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("k"), F.greatest("small", F.lit(1)))).otherwise(F.col("own.first") + F.pmod(F.xxhash64("k"), F.coalesce("own.n", F.lit(1))))
    dealt = dealt.withColumn("block", block.cast("int"))
    some = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    others = F.concat(some(F.lit(0), F.col("own.first") - 1), some(F.col("own.first") + F.col("own.n"), F.col("blocks") - 1))
    met = F.when(F.col("own").isNull(), some(F.lit(0), F.col("blocks") - 1)).otherwise(others)
    # a block goes to the tasks of (larger block, smaller block) that it is one of
    to = F.transform(met, lambda j: F.struct(F.greatest("block", j).alias("i"), F.least("block", j).alias("j")))
    columns = ("g", "i", "j", "k", "c", "n_shingles", "sig", "block", "blocks")
    rows = dealt.withColumn("to", F.explode(to)).select("g", "to.i", "to.j", "k", "c", "n_shingles", "sig", "block", "blocks")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
    schema = pa.schema(list(zip(columns, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in block_rows(batches, columns):
            ks, cs, ns, blocks = (np.array([r[n] for r in held], np.int64) for n in (3, 4, 5, 7))
            near = near_pairs(ks, cs, ns, blocks, unpack([r[6] for r in held]), held[0][1], held[0][2], threshold)
            need = sorted({p for _, *pair in near for p in pair})
            yield pa.RecordBatch.from_arrays([pa.array([held[p][n] for p in need], f.type) for n, f in enumerate(schema)], schema=schema)

    return by_pairs(rows).mapInArrow(run, "g long, i int, j int, k long, c long, n_shingles long, sig binary, block int, blocks int")


def across(met: DataFrame, threshold: float, percent: int, width: int) -> DataFrame:
    """Links (a, b) that join different components of a group. `met`: what `meeting` gives, with the text t."""
    columns = ("g", "i", "j", "k", "c", "n_shingles", "sig", "block", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_set = sets_of(width)
        for held in block_rows(batches, columns):
            ks, cs, ns, blocks = (np.array([r[n] for r in held], np.int64) for n in (3, 4, 5, 7))
            near = near_pairs(ks, cs, ns, blocks, unpack([r[6] for r in held]), held[0][1], held[0][2], threshold)
            sets: dict[int, np.ndarray] = {}
            root = {int(c): int(c) for c in cs}

            def find(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = c = root[root[c]]  # noqa: B023
                return c

            out: list[tuple[int, int]] = []
            for _, p, x in sorted(near, key=lambda e: (-e[0], e[1], e[2])):
                u, v = find(int(cs[p])), find(int(cs[x]))
                if u == v:
                    continue
                for i in (p, x):
                    if i not in sets:
                        sets[i] = to_set(held[i][8])
                common = len(np.intersect1d(sets[p], sets[x], assume_unique=True))
                if 100 * common >= percent * (len(sets[p]) + len(sets[x]) - common):
                    root[max(u, v)] = min(u, v)
                    out.append((int(ks[p]), int(ks[x])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([max(o) for o in out], pa.int64()), "b": pa.array([min(o) for o in out], pa.int64())})

    return by_pairs(met.select(*columns, "blocks")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of the shingle sets."""
    threshold = percent / 100
    src = docs.select(quoted(key).cast("long").alias("k"), quoted(text).alias("t"))
    signed = checkpointed(signatures(spread(src), width))
    # one row per key, then one class per set; rows without a set stand alone
    of = signed.where("k is not null").groupBy("k").agg(F.min_by(F.struct("digest", "n_shingles"), "th").alias("x")).select("k", "x.*").where("digest is not null")
    of = checkpointed(of)
    # two plain tables, so that Spark can split the join where one set has very many copies
    firsts = checkpointed(of.groupBy("digest", "n_shingles").agg(F.min("k").alias("rep")))
    classes = checkpointed(of.join(firsts, ["digest", "n_shingles"]).select("k", "digest", "n_shingles", "rep"))
    chosen = classes.where("k = rep").select("k", "digest", "n_shingles")
    reps = checkpointed(signed.join(chosen, ["k", "digest", "n_shingles"]).dropDuplicates(["k"]).select("k", "n_shingles", "sig", "bands"))

    buckets = reps.select("k", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("k").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = checkpointed(buckets.join(heads.select("bucket", "b"), "bucket"))
    stars = mates.where("k <> b").select(F.col("k").alias("a"), "b").distinct()
    pairs = checkpointed(estimated(stars, reps, threshold))
    # texts of all that share a bucket, once for both confirmations
    path = texts_of(src, mates.select("k"))
    texts = docs.sparkSession.read.parquet(path)
    links = confirmed(pairs, texts, percent, width)
    comp = checkpointed(components(links))

    # groups of more than one component: links across them. A group's members meet it by salt, as it may have very many
    placed = checkpointed(mates.select(F.col("b").alias("g"), "k").distinct().join(comp, "k", "left").select("g", "k", F.coalesce("c", "k").alias("c")))
    salted = groups_in_blocks(placed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = placed.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"])
    members = checkpointed(members.drop("salt"))
    if not members.isEmpty():
        met = checkpointed(meeting(members.join(reps.select("k", "n_shingles", "sig"), "k"), threshold))
        more = checkpointed(across(met.join(texts, "k"), threshold, percent, width))
        joined = more.join(comp.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a", "left").join(comp.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b", "left")
        between = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        comp = checkpointed(components(between.unionByName(comp.select(F.col("k").alias("a"), F.col("c").alias("b")))))

    drop_path(docs.sparkSession, path)
    whole = classes.join(comp.select(F.col("k").alias("rep"), "c"), "rep", "left").select("k", F.coalesce("c", "rep").alias("component_id"))
    out = signed.select("k", "n_shingles").join(whole, "k", "left").select("k", "n_shingles", F.coalesce("component_id", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), "n_shingles", "component_id", (F.col("k") == F.col("component_id")).alias("kept"))
