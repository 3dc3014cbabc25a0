"""Resumable incremental processing as a stream of new input files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.groups import pending
from ..sources.tables import exists, four_tables, nan_to_nulls

#: Tables of a sample and the keys of their rows; the last is the ledger, written when the others are.
KEYS = {"cleaned_samples": ["sample_id"], "candidate_paths": ["sample_id", "candidate_index"], "entropy_features": ["sample_id", "candidate_index", "token_index"], "step1_dataset": ["sample_id"]}


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/step1_dataset"
    return spark.read.parquet(path).select("sample_id") if exists(spark, path) else spark.createDataFrame([], "sample_id string")


def write_batch(samples: DataFrame, folder: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """[S13 J7] What the ledger lacks of a batch: processed and written to four tables, the ledger last.

    A batch that died between tables is written again: its side rows stand twice until `side_table` reads them once."""
    spark = samples.sparkSession
    done = process(pending(samples.dropDuplicates(["sample_id"]), ledger(spark, folder), "sample_id")).persist()
    try:
        for name, df in four_tables(done).items():
            nan_to_nulls(df).write.mode("append").parquet(f"{folder}/{name}")
    finally:
        done.unpersist()


def run(spark: SparkSession, source: str, schema: str | StructType, folder: str, process: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """[S20 §2.11] JSON files of `source` not yet seen, batch by batch, until none is left; start it again for more."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda df, _: write_batch(df, folder, process)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def side_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A side table without the repeats of a resumed run, restricted to samples that the ledger has."""
    rows = spark.read.parquet(f"{folder}/{name}").dropDuplicates(KEYS[name])
    if name == "step1_dataset":  # the ledger itself: of these only those without an id aren't in it
        return rows.where("sample_id is not null")
    return rows.join(ledger(spark, folder).distinct(), "sample_id", "left_semi")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events per window and type, batch or stream; a stream forgets windows `late` after their end."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of users by gaps."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
