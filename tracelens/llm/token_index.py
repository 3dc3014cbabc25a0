"""Token-ID shards with a minimal perfect hash index.

`write_shards` puts documents in ascending key order, encodes each whole text, appends the
end id, and writes shards: one Parquet row per shard (Spark's commit protocol makes lost
tasks safe, and any store that Spark writes to will do). A shard row holds

* `part`, `seq`: place of the shard in the global order;
* `n_docs`, `n_tokens`, `min_key`, `max_key`;
* `payload`: the raw ids of its documents, little-endian, `width` bytes each;
* `keys`: its document keys (little-endian int64) in order, `null_keys` of them null at the front;
* `index`: the minimal perfect hash index over the distinct keys (see `build_index`): key ->
  (fingerprint, first id, number of ids) without storing or comparing keys.

`Shard.lookup` gives a document's ids in constant expected time: a bit test per level, a
rank, a fingerprint comparison, and one slice of the payload. A foreign key is refused
unless its 32-bit fingerprint collides.

`write_directory` puts a minimal perfect hash index over the keys of all shards beside them, in buckets by hash: key -> (fingerprint, shard, first
id and number of ids). `lookup` reads one document by its key from one row of the directory and one shard; `fetch` does so for a table of keys.

Nulls: a null text is an empty one; null keys come first, are stored and read back, and
cannot be looked up. Repeated keys: all their documents are stored next to each other; the
index points to the first of the shard. Very long texts are one document in one shard,
which then exceeds the size aimed at. An empty table gives no shard and no row. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, mix64, quoted, shared_path

MEMO_WORDS, MEMO_WORD, SLICE = 700_000, 64, 500
#: Characters whose class and lower case are the same in every Unicode version: texts of these only are cut here, by the tokenizer's own rule.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SIGNS = "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20ac"
_LATIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}{_SIGNS}]*")
_SPACES = r"\t\n\r\x20"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACES}{_LETTERS}0-9]+")
#: The rule of the tokenizers for which _SPLIT holds.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHARD_TOKENS = 1 << 20
GAMMA, LEVELS = 1.5, 24
DIRECTORY_SCHEMA, BUCKET_KEYS = "bucket int, buckets int, n_keys int, index binary", 1 << 15
SHARD_SCHEMA = "part int, seq int, n_docs int, n_tokens long, min_key long, max_key long, null_keys int, width int, payload binary, keys binary, lengths binary, index binary"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids as the tokenizers library gives them for whole texts, as little-endian bytes.

    For a tokenizer of the known kind (composition, space folding and lower case; then a cut
    by _RULE; byte-level merges inside each pre-token), a text of plain Latin characters is
    cut here and each distinct pre-token is encoded by the library's model once while the
    bounded memo lasts. All other texts and tokenizers go through the library whole."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        top = max(self.tok.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_run = self._known(spec) and sys.byteorder == "little"
        self.memo: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()

    @staticmethod
    def _known(spec: dict) -> bool:
        norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        folds = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        steps = pre.get("pretokenizers") or [{}]
        cut, level = steps[0], steps[-1]
        return (
            norm.get("normalizers") == [{"type": "NFC"}, folds, {"type": "Lowercase"}]
            and len(steps) == 2
            and (cut.get("type"), cut.get("behavior"), cut.get("invert")) == ("Split", "Removed", True)
            and cut["pattern"].get("Regex") == _RULE
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and spec.get("post_processor") is None
            and model["type"] == "BPE"
            and not model.get("ignore_merges")
            and not model.get("dropout")
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_run:
            return self._whole(texts)
        memo, split, tokenize, alphabet, code = self.memo, _SPLIT.findall, self.model.tokenize, self.alphabet, self.code
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out: list[bytes | None] = []
        rest: list[int] = []
        for i, text in enumerate(texts):
            if _LATIN.fullmatch(text) is None or any(x in text for x in self.special):
                rest.append(i)
                out.append(None)
                continue
            runs = split(text.lower())
            try:
                out.append(b"".join(map(memo.__getitem__, runs)))
                continue
            except KeyError:
                pass
            long = []
            for r in set(runs):
                if r not in memo:
                    as_bytes = r if r.isascii() else r.encode().decode("latin-1").translate(alphabet)
                    memo[r] = array(code, [t.id for t in tokenize(as_bytes)]).tobytes()
                    if len(r) > MEMO_WORD:
                        long.append(r)
            out.append(b"".join(map(memo.__getitem__, runs)))
            for r in long:
                del memo[r]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


def build_index(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Minimal perfect hash over distinct int64 keys, with fingerprint and value of each.

    Level by level, keys that meet no other key in a bit array of GAMMA times as many bits
    take their bit; the rest go on to the next level (the last level's rest is kept as
    sorted keys, normally none). A key's number is the rank of its bit. Layout, all
    little-endian: levels, per level its bit count and bytes, count of leftover keys and
    they, then uint32 fingerprints and uint64 pairs (first id, number of ids) by number."""
    u = keys.astype("<i8").view("<u8")
    left = np.arange(len(u))
    parts, order, n_levels = [], [], 0
    while len(left) and n_levels < LEVELS:
        size = max(64, int(len(left) * GAMMA) + 63 & ~63)
        slot = _slots(u[left], n_levels, size).astype(np.int64)
        count = np.bincount(slot, minlength=size)
        alone = count[slot] == 1
        bits = np.zeros(size, np.uint8)
        bits[slot[alone]] = 1
        parts.append(struct.pack("<I", size) + np.packbits(bits, bitorder="little").tobytes())
        placed = left[alone]
        order.append(placed[np.argsort(slot[alone], kind="stable")])
        left = left[~alone]
        n_levels += 1
    rest = left[np.argsort(keys[left], kind="stable")]
    order.append(rest)
    at = np.concatenate(order) if order else np.empty(0, np.int64)
    prints = (mix64(u[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    return struct.pack("<I", n_levels) + b"".join(parts) + struct.pack("<I", len(rest)) + keys[rest].astype("<i8").tobytes() + prints.tobytes() + values[at].astype("<u8").tobytes()


class Index:
    """Reads what build_index wrote."""

    def __init__(self, data: bytes):
        (n_levels,), at = struct.unpack_from("<I", data), 4
        self.levels, total = [], 0
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<I", data, at)
            words = np.frombuffer(data, "<u8", size // 64, at + 4)
            before = total + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((size, words, before))
            total, at = int(before[-1]), at + 4 + size // 8
        (n_rest,) = struct.unpack_from("<I", data, at)
        self.rest, at = np.frombuffer(data, "<i8", n_rest, at + 4), at + 4 + 8 * n_rest
        self.base = total
        n = total + n_rest
        self.prints = np.frombuffer(data, "<u4", n, at)
        self.values = np.frombuffer(data, "<u8", 2 * n, at + 4 * n).reshape(n, 2)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for keys whose fingerprint differs."""
        keys = np.asarray(keys, "<i8")
        u = keys.view("<u8")
        out, left = np.full(len(u), -1, np.int64), np.arange(len(u))
        for level, (size, words, before) in enumerate(self.levels):
            slot = _slots(u[left], level, size)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            mask = (np.uint64(1) << bit) - np.uint64(1)
            out[left[hit]] = (before[word] + np.bitwise_count(words[word] & mask))[hit]
            left = left[~hit]
        if len(self.rest) and len(left):
            p = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[p] == keys[left]
            out[left[hit]] = self.base + p[hit]
        known = out >= 0
        mine = (mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        out[known & (self.prints[np.maximum(out, 0)] != mine if len(self.prints) else True)] = -1
        return out


class Shard:
    """A shard row; `lookup(key)` gives the ids of a document, or None."""

    def __init__(self, row: dict):
        self.row, self.ids = row, np.frombuffer(row["payload"], f"<u{row['width']}")
        self.index = Index(row["index"])

    def lookup(self, key: int) -> np.ndarray | None:
        k = self.index.find(np.array([key]))[0]
        if k < 0:
            return None
        first, n = map(int, self.index.values[k])
        return self.ids[first : first + n]


def _pack(part: int, seq: int, keys: list, blobs: list[bytes], width: int) -> dict:
    nulls = sum(k is None for k in keys)
    ks = np.array([k for k in keys if k is not None], "<i8")
    lengths = np.array([len(b) // width for b in blobs], "<u4")
    firsts = np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)]) if len(blobs) else np.empty(0, np.int64)
    distinct, first_at = np.unique(ks, return_index=True)
    values = np.stack([firsts[nulls:][first_at], lengths[nulls:][first_at].astype(np.int64)], 1) if len(ks) else np.empty((0, 2), np.int64)
    return {
        "part": part, "seq": seq, "n_docs": len(keys), "n_tokens": int(lengths.sum()), "min_key": int(ks[0]) if len(ks) else None, "max_key": int(ks[-1]) if len(ks) else None,
        "null_keys": nulls, "width": width, "payload": b"".join(blobs), "keys": ks.tobytes(), "lengths": lengths.tobytes(), "index": build_index(distinct, values),
    }


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shards of all documents to `path`. One range shuffle by key; text is its only wide column."""
    src = docs.select(quoted(key).cast("long").alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = enc.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("null_keys", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("keys", pa.binary()), ("lengths", pa.binary()), ("index", pa.binary())])
        keys: list = []
        blobs: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_pack(part, seq, keys, blobs, width)], schema)

        for b in lean(batches):
            for i in range(0, b.num_rows, SLICE):
                x = b.slice(i, SLICE)
                for k, ids in zip(x.column("k").to_pylist(), enc(x.column("t").to_pylist()), strict=True):
                    ids += end
                    keys.append(k)
                    blobs.append(ids)
                    size += len(ids)
                    if size >= shard_tokens * width:
                        yield out()
                        keys, blobs, size, seq = [], [], 0, seq + 1
        if keys:
            yield out()

    # repeated keys are told apart by their text, so that a hot key spreads over partitions
    ordered = src.repartitionByRange(F.col("k"), F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per stored document: key, start, n_tokens, ids_crc32, part, seq, found (its key's lookup gives its ids; null for null keys)."""
    shards = spark.read.parquet(path)
    # ids before each shard: parts first, then the shards of a part, so that no task orders all shards
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    w = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("in_part")).join(before, "part").select("part", "seq", (F.col("in_part") + F.col("before_part")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = Shard(row)
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                firsts = np.cumsum(lengths) - lengths
                keys = np.frombuffer(row["keys"], "<i8")
                wide = s.ids.astype("<u4")
                nulls = row["null_keys"]
                crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(firsts.tolist(), lengths.tolist(), strict=True)]
                at = s.index.find(keys)
                # a repeated key's lookup gives the first of its documents
                first = np.searchsorted(keys, keys, side="left") + nulls
                found = (at >= 0) & (s.index.values[at, 0].astype(np.int64) == firsts[first]) & (s.index.values[at, 1].astype(np.int64) == lengths[first]) if len(keys) else np.empty(0, bool)
                n = len(lengths)
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": pa.array([None] * nulls + keys.tolist(), pa.int64()), "first": pa.array(firsts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                        "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "found": pa.array([None] * nulls + found.tolist(), pa.bool_()),
                    }
                )

    rows = shards.mapInArrow(documents, "k long, first long, n_tokens long, ids_crc32 long, part int, seq int, found boolean")
    joined = rows.join(starts, ["part", "seq"])
    return joined.select(F.col("k").alias(key), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "found")


def bucket_of(key: int, buckets: int) -> int:
    """The directory's bucket of a key: pmod(xxhash64(key), buckets), as Spark computes it."""
    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def write_directory(spark: SparkSession, shards_path: str, path: str, bucket_keys: int = BUCKET_KEYS) -> None:
    """Write the directory of all shards: for each bucket of keys, by hash, a minimal perfect hash index from key to shard and place in its payload.

    Of a key that stands in several shards the first counts. One shuffle of 32 bytes a key; a task holds one bucket."""
    shards = spark.read.parquet(shards_path)
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket_keys))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for r in b.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                firsts = (np.cumsum(lengths) - lengths)[r["null_keys"] :]
                keys, at = np.unique(np.frombuffer(r["keys"], "<i8"), return_index=True)
                shard = np.full(len(keys), r["part"] << 32 | r["seq"], np.int64)
                place = firsts[at] << 32 | lengths[r["null_keys"] :][at]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shard), pa.array(place)], names=["k", "shard", "place"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def index() -> pa.RecordBatch:
            rows = np.concatenate(held)
            keys, first = np.unique(rows[:, 0], return_index=True)
            data = build_index(keys, rows[first, 1:])
            return pa.RecordBatch.from_pydict({"bucket": pa.array([at], pa.int32()), "buckets": pa.array([buckets], pa.int32()), "n_keys": pa.array([len(keys)], pa.int32()), "index": pa.array([data], pa.binary())})

        for b in lean(batches):
            number = b.column("bucket").to_numpy()
            rows = np.stack([b.column(c).to_numpy() for c in ("k", "shard", "place")], 1)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and number[lo] != at:
                    yield index()
                    held = []
                at = int(number[lo])
                held.append(rows[lo:hi])
        if held:
            yield index()

    rows = shards.select("part", "seq", "null_keys", "keys", "lengths").mapInArrow(entries, "k long, shard long, place long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "k", "shard")
    rows.mapInArrow(build, DIRECTORY_SCHEMA).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, shards_path: str, directory_path: str, key: int) -> np.ndarray | None:
    """The ids of one document by its key, or None: one row of the directory and one of the shards are read."""
    some = spark.read.parquet(directory_path)
    head = some.select("buckets").first()
    if head is None:
        return None
    row = some.where(F.col("bucket") == bucket_of(key, head["buckets"])).select("index").first()
    index = Index(row["index"]) if row else None
    at = index.find(np.array([key]))[0] if index else -1
    if at < 0:
        return None
    shard, place = (int(v) for v in index.values[at])
    held = spark.read.parquet(shards_path).where((F.col("part") == shard >> 32) & (F.col("seq") == (shard & 0xFFFFFFFF))).select("payload", "width").first()
    return _slice(np.frombuffer(held["payload"], f"<u{held['width']}"), place)


def _slice(ids: np.ndarray, place: int) -> np.ndarray:
    return ids[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)]


def fetch(spark: SparkSession, shards_path: str, directory_path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ids of all those keys (distinct, not null) that the shards hold. Keys go to their buckets of the directory, then to their shards, of which only these are read."""
    directory = spark.read.parquet(directory_path)
    head = directory.select("buckets").first()
    asked = keys.select(quoted(key).cast("long").alias("k")).where("k is not null").distinct()
    buckets = head["buckets"] if head else 1
    asked = asked.select(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("role"), "k", F.lit(None).cast("binary").alias("index"))
    both = asked.unionByName(directory.select("bucket", F.lit(0).alias("role"), F.lit(None).cast("long").alias("k"), "index"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for b in lean(batches):
            out: tuple[list, list, list] = ([], [], [])
            for bucket, role, k, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "role", "k", "index")), strict=True):
                if role == 0:
                    at, index = bucket, Index(data)
                elif bucket == at:
                    n = int(index.find(np.array([k]))[0])
                    if n >= 0:
                        for c, v in zip(out, (k, *index.values[n]), strict=True):
                            c.append(int(v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["k", "shard", "place"])

    located = checkpointed(both.repartition("bucket").sortWithinPartitions("bucket", "role").mapInArrow(find, "k long, shard long, place long"))
    shards = spark.read.parquet(shards_path).select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq")).alias("shard"), "width", "payload")
    wanted = shards.join(located.select("shard").distinct(), "shard", "left_semi")
    none = F.lit(None)
    rows = wanted.select("shard", F.lit(0).alias("role"), "width", "payload", none.cast("long").alias("k"), none.cast("long").alias("place"))
    rows = rows.unionByName(located.select("shard", F.lit(1).alias("role"), none.cast("int").alias("width"), none.cast("binary").alias("payload"), "k", "place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        for b in lean(batches):
            for i in range(0, b.num_rows, SLICE):
                found, lists = [], []
                for r in b.slice(i, SLICE).to_pylist():
                    if r["role"] == 0:
                        ids = np.frombuffer(r["payload"], f"<u{r['width']}")
                    else:
                        found.append(r["k"])
                        lists.append(_slice(ids, r["place"]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["k", "ids"])

    return rows.repartition("shard").sortWithinPartitions("shard", "role", "place").mapInArrow(cut, "k long, ids array<long>").withColumnRenamed("k", key)


def token_index(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the shards of `docs` (to the folder shards of a new folder of the shared one unless `path` is given) and their directory, and read all documents back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_shards(docs, f"{path}/shards", tokenizer_path, end_id, key, text)
    write_directory(spark, f"{path}/shards", f"{path}/directory")
    return read_shards(spark, f"{path}/shards", key)
