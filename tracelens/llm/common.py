"""Helpers shared by the training-data operators: storage, columns, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: A word: a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset in local mode (tests) a temporary folder is taken; on a cluster, executors would not see it."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tracelens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. After each, what is free again goes back to the system: workers are kept for later tasks, several on each machine."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        _trim()


def word_list(text: str | None) -> list[bytes]:
    """Words of a text as the contracts define them (see WORD), A-Z lower-cased, in UTF-8.

    Of bytes, lower() and split() know ASCII only: A-Z, and space with U+0009..U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash:
    """64-bit hash of words, memoised in a bounded dictionary."""

    def __init__(self, limit: int = 150_000):
        import xxhash

        self._h, self._memo, self._limit = xxhash.xxh3_64_intdigest, {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self._memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > self._limit:
                memo.clear()
            h = self._h
            for w in set(words):
                if w not in memo:
                    memo[w] = h(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; a shorter sequence is one shingle, none for no words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(width, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - w + 1, np.uint64(w), np.uint64)
        for i in range(w):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - w + 1 + i])
    return np.unique(acc)


def quoted(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, ..: batch functions don't take names with dots. `toDF(*df.columns)` names them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns of `df` (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


__all__ = ["WORD", "WordHash", "all_of", "checkpointed", "drop_path", "fresh", "lean", "mix64", "numbered", "quoted", "shared_dir", "shared_path", "shingle_set", "spread", "table", "word_list"]
