"""The corpus pipeline: documents through the stages below, each written as Parquet and read again by the next.

Toxic documents go, then all but one of each group of near copies, then documents that hold benchmark
passages; the rest is mixed to target weights by source, and the mix is written as token-id shards.
Its rows are those that the last stage reads back from its shards.

Null and empty texts pass the first three stages and, having no words, are not taken by the mix. Very long texts are whole in every stage. Of fully
repeated rows and of near copies one stays (the smallest key; of one key the text of the smallest hash); rows without a key stay and come first. Extra columns pass all
stages but the last, whatever their names. An empty table gives an empty result. An intermediate table is dropped when the stage that reads it is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import stages
from tracelens.llm.common import drop_path, shared_path, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_benchmark),
    ("source_mixing", stages.mix),
    ("token_id_output", stages.index_tokens),
]

#: None of SQL's engines learns the toxicity stage; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`: doc_id, start, n_tokens and ids_crc32 of each document of the mix."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # writes its shards; what it returns reads them only
    if before:
        drop_path(spark, before)
    return out
