"""Readers and writers of the record files: JSON lines, JSON arrays, CSV; ledgers, manifests and side files."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from ..functions.text import clean_whitespace, json_safe, number_or_nan, sample_key, source_metadata
from . import schemas

#: Tables of less than this for each core may be one file with one group of rows, which is read in one task.
SMALL = 4 << 20


def spread(df: DataFrame, fine: bool = False) -> DataFrame:
    """The same rows over all cores, where a table is so small that its files don't give each core a part. No result depends on it.

    With `fine`, a larger table is dealt into parts of SMALL bytes, so that a task with much to do for each byte is as long over any table; files
    alone give parts of whole row groups."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if fine:
        return df.repartition(max(cores, -(-size // SMALL)))
    return df.repartition(cores) if size < cores * min(SMALL, split) and len(df.inputFiles()) < cores else df


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """[S1 S10] JSON lines with a fixed schema; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def completed_ids(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """[S2 S20] Distinct ids of a ledger. Torn lines, ids that aren't strings and a missing file are no error."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    v = F.try_parse_json(F.col("value"))
    x = F.try_variant_get(v, f"$.{key}", "variant")
    rows = spark.read.text(path).select(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$.{key}", "string")).alias(key))
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def _nan(kind: DataType, c):
    """Nested doubles with null as NaN."""
    if isinstance(kind, DoubleType):
        return number_or_nan(c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_nan(f.dataType, c[f.name]).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(F.filter(c, lambda x: x.isNotNull()) if isinstance(kind.elementType, StructType) else c, lambda x: _nan(kind.elementType, x))
    return c


def _null(kind: DataType, c):
    """Nested doubles with NaN and infinities as null."""
    if isinstance(kind, DoubleType):
        return json_safe(c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_null(f.dataType, c[f.name]).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _null(kind.elementType, x))
    return c


def nulls_to_nan(df: DataFrame) -> DataFrame:
    return df.select(*[_nan(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def nan_to_nulls(df: DataFrame) -> DataFrame:
    """[P32] What JSON can hold."""
    return df.select(*[_null(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """[S3] Nested samples; children that are null go, missing numbers are NaN, missing texts empty."""
    df = nulls_to_nan(read_jsonl(spark, path, schemas.SAMPLE))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("dataset", "sample_id", "question", "answer_raw", "answer_normalized")}
    return df.withColumns(texts | {"candidates": F.coalesce("candidates", F.array().cast(df.schema["candidates"].dataType))})


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """[S4 S8] By suffix: .jsonl, .json (one array), .csv (with header, a byte order mark is dropped), and .parquet, .orc as an extension."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read.schema(schema) if schema else spark.read
    if suffix == "jsonl":
        return r.option("mode", "FAILFAST").json(path)
    if suffix == "json":
        return r.option("mode", "FAILFAST").option("multiLine", True).json(path)
    if suffix == "csv":
        df = r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    if suffix in ("parquet", "orc"):
        return r.format(suffix).load(path)
    raise ValueError(f"no reader for {suffix!r}: use .jsonl, .json, .csv, .parquet or .orc")


def gsm8k(rows: DataFrame, split: str, revision: str = "main") -> DataFrame:
    """[S5 P1 P2 P3] Rows of question, answer and a stored `row` number as cleaned samples."""
    return rows.select(
        F.lit("gsm8k").alias("dataset"), sample_key("gsm8k", F.lit(split), F.col("row")).alias("sample_id"), clean_whitespace(F.col("question")).alias("question"), clean_whitespace(F.col("answer")).alias("answer_raw"),
        F.lit("").alias("answer_normalized"), F.lit(split).alias("split"), source_metadata(source="gsm8k", hf_split=split, hf_row_index=F.col("row"), revision=revision).alias("metadata"),
    )


def math500(rows: DataFrame, split: str = "test", revision: str = "main") -> DataFrame:
    """[S6] Rows of problem, solution, answer, unique_id, subject, level; the raw answer is the whole solution, the short one is metadata."""
    return rows.select(
        F.lit("math500").alias("dataset"), F.concat(F.lit("math500:"), F.col("unique_id")).alias("sample_id"), clean_whitespace(F.col("problem")).alias("question"), clean_whitespace(F.col("solution")).alias("answer_raw"),
        F.lit("").alias("answer_normalized"), F.lit(split).alias("split"),
        source_metadata(source="math500", hf_split=split, revision=revision, unique_id=F.col("unique_id"), subject=F.col("subject"), level=F.col("level"), boxed_answer=F.col("answer")).alias("metadata"),
    )


def all_sources(*tables: DataFrame) -> DataFrame:
    """[S7] Sources under each other; `ordinal` keeps their order."""
    frames = [t.withColumn("ordinal", F.lit(i)) for i, t in enumerate(tables)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    """[S11 S12 S14 S23 S24] JSON lines, with nulls written and NaN as null; a folder per value of `by`."""
    w = nan_to_nulls(df).write.option("ignoreNullFields", False).mode("append" if append else "overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """[S18] One CSV file with header; for report tables, not for data."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """[S16 S17] A table of one row as JSON."""
    nan_to_nulls(df).coalesce(1).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def manifest(counters: dict, args) -> dict:
    """[S16] What a run did: counters, arguments (everything JSON can't hold as text) and when."""
    plain = asdict(args) if is_dataclass(args) else dict(args)
    return {"created_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **counters, "args": json.loads(json.dumps(plain, default=str))}


def four_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """[S13 S15 G12] cleaned, paths, entropy and step1 rows of nested samples; step1 is the ledger and is to be written last."""
    head = ["sample_id", "dataset", "split"]
    cand = samples.select(*head, F.posexplode("candidates").alias("candidate_index", "c"))
    return {
        "cleaned_samples": samples.drop("candidates"),
        "candidate_paths": cand.select(*head, "candidate_index", "c.reasoning_text", "c.predicted_answer_raw", "c.predicted_answer_normalized"),
        "entropy_features": cand.select(*head, "candidate_index", F.explode("c.tokens").alias("t")).select(*head, "candidate_index", "t.token_index", "t.logprob", "t.entropy"),
        "step1_dataset": samples,
    }


def export(samples: DataFrame, folder: str, append: bool = False) -> None:
    """[S15] The four tables, the ledger last. Samples are made once for all four, and kept in memory or, what doesn't fit, on disk meanwhile."""
    samples = samples.persist()
    try:
        for name, df in four_tables(samples).items():
            write_jsonl(df, f"{folder}/{name}.jsonl", append)
    finally:
        samples.unpersist()


def nested_get(config: dict, path: str, default=None):
    """[S9] A value by dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def split_failures(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """[S21] Rows that are ok and the dead letters; both count as processed."""
    ok = F.col(status).eqNullSafe(F.lit("ok"))
    return df.where(ok), df.where(~ok)


@dataclass
class GenerationConfig:
    """How candidates are generated."""

    k: int = 4
    temperature: float = 0.7
    top_p: float = 0.95
    max_tokens: int = 2048
    seed: int | None = None
    system_prompt: str | None = None
    extra: dict = field(default_factory=dict)


def echo_candidates(samples: DataFrame, config: GenerationConfig) -> DataFrame:
    """[X5 G11] Candidates whose text is `#### i`, without a model."""
    if config.k < 1:
        raise ValueError("k must be at least 1")
    texts = F.transform(F.sequence(F.lit(0), F.lit(config.k - 1)), lambda i: F.format_string("#### %d", i.cast("int")))
    return samples.withColumn("texts", texts)


def function_candidates(samples: DataFrame, backend: Callable[[str, int], str], config: GenerationConfig, question: str = "question") -> DataFrame:
    """[X1 X4 X6] Candidates of a callable (question, index) -> text, a batch of rows at a time on the executors. Failures are retried with back-off, then null."""
    if config.k < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            b["texts"] = [[with_retry(lambda i=i, q=q: backend(q, i)) for i in range(config.k)] for q in b[question]]
            yield b

    return samples.mapInPandas(run, StructType.fromDDL(f"{samples.schema.toDDL()}, texts array<string>"))


def with_retry(call: Callable[[], str], tries: int = 3, wait: float = 0.1, most: float = 30.0) -> str | None:
    """[§2.14] The call's value; after `tries` failures null."""
    for i in range(tries):
        try:
            return call()
        except Exception:  # any failure of a backend counts
            if i + 1 < tries:
                time.sleep(min(most, wait * 2**i) * (1 + random.random() / 10))
    return None
