"""The operators as stages over a table of documents: what each one decides takes effect on the rows.

Every stage takes (spark, docs, folder of tables). All but the last return the columns of `docs`, in their order and whatever they are
called (names of columns that a stage adds on the way are chosen so that they don't clash). Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontam, mixing, neardup, queries, token_index, toxicity
from .common import all_of, checkpointed, fresh, quoted, table

PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts hold no toxic word and stay; texts are scored whole; each of repeated rows is kept or dropped like the others."""
    scored, score, _ = toxicity.score_rows(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(score) < 0.5).select(*all_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    A document is a key with its text: of fully repeated ones one row stays (the first by its other columns' hash), and different texts of one key are
    judged each for itself. The document with the smallest key stays, of one key the text with the smallest hash. Rows without a key stay, and so do
    null and empty texts, which are like nothing."""
    k, text = quoted("doc_id"), quoted("text")
    hashed, node, other = fresh(docs, "_hash", "_node", "_other")
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()))
    pairs = rows.where(k.isNotNull()).select(k.cast("long").alias("k"), F.col(hashed).alias("h"))
    several = pairs.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("k")
    if several.isEmpty():
        judged = docs.select(k.cast("long").alias("doc_id"), text.alias("text"))
        kept = neardup.near_duplicates(judged, percent=PERCENT, width=5).where("kept").select(F.col("doc_id").alias(node)).distinct()
        kept = rows.join(kept, k.cast("long") == F.col(node), "left_semi")
    else:
        # documents numbered by (key, hash), so that the smallest number of a group is its smallest key
        name = F.lpad(F.hex(F.col("k").bitwiseXOR(F.lit(-1 << 63))), 16, "0")
        named = pairs.distinct().withColumn("name", name)
        chunks = [F.substring("name", 1, n).alias(c) for n, c in ((13, "fine"), (9, "coarse"))]
        named = checkpointed(named.select("k", "h", "name", *chunks, F.lit(0).alias("all")))
        numbered = checkpointed(mixing.running(named, ["all"], ["fine", "coarse"], [F.col("name"), F.col("h")], F.lit(1), "number").select("k", "h", "number"))
        on = (k.cast("long") == F.col("k")) & (F.col(hashed) == F.col("h"))
        judged = docs.select(k.cast("long").alias("_k"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_h"))
        judged = judged.join(numbered, (F.col("_k") == F.col("k")) & (F.col("_h") == F.col("h"))).select(F.col("number").alias("doc_id"), "text")
        best = neardup.near_duplicates(judged, percent=PERCENT, width=5).where("kept").select("doc_id").distinct()
        best = numbered.join(best, numbered["number"] == best["doc_id"], "left_semi").select(F.col("k").alias(node), F.col("h").alias(other))
        kept = rows.join(best, (k.cast("long") == F.col(node)) & (F.col(hashed) == F.col(other)), "left_semi")
    return kept.dropDuplicates(["doc_id", hashed]).select(*all_of(docs)).unionAll(docs.where(k.isNull()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; texts are read whole; repeated rows are treated alike."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its size, rounded to whole documents, in the order of the schedule.

    A copy stands where the schedule has its first block of the pass that it belongs to. Rows of one key are taken as often as
    they are on average. Null and empty texts have no words and are not taken; a null source is a source; null keys count as one key."""
    key, times, slots, copy, slot = fresh(docs, "_id", "_times", "_slots", "_copy", "_slot")
    taken = mixing.mix_sources(docs).groupBy("doc_id").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("t"), F.min("slots").alias("s"))
    taken = taken.select(F.col("doc_id").alias(key), F.floor(F.col("t") + 0.5).cast("int").alias(times), F.col("s").alias(slots)).where(F.col(times) > 0)
    out = docs.join(taken, quoted("doc_id").eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    out = out.withColumn(slot, F.coalesce(F.get(slots, F.col(copy) - 1), F.get(slots, F.lit(0)), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, slot, quoted("doc_id"), copy).sortWithinPartitions(slot, quoted("doc_id"), copy).select(*all_of(docs))


def index_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of the documents, read back: doc_id, start, n_tokens and ids_crc32 of each.

    Null texts are empty and have the end id alone; repeated rows and rows of one key each have their own place; null keys come first."""
    index = token_index.token_index(docs, queries.tokenizer_path(queries.WORD_TOKENIZER), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
