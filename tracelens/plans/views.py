"""The driver's tables as candidates, predictions, runs, tokens, messages and teacher rows, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of `documents` for queries whose work is in the texts: a small table is spread over the cores."""
    return spread(read(spark, sf_dir, "documents").select(*columns))


#: A made-up label and a made-up verdict of a candidate.
OK, YES = "event_id % 3 <> 0", "value >= 30"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("q"), F.col("event_id").alias("pos"), F.col("event_type").alias("ans"), F.col("value").alias("score"), F.expr(YES).alias("yes"), F.expr(OK).alias("ok"), F.to_date("ts").alias("day"))


C = f"c AS (SELECT user_id AS q, event_id AS pos, event_type AS ans, value AS score, {YES} AS yes, {OK} AS ok, ts::DATE AS day FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a question for each user and day."""
    return candidates(spark, sf_dir).withColumn("q", F.concat_ws(":", F.col("q").cast("string"), F.col("day").cast("string")))


D = "d AS (SELECT q || ':' || day AS q, pos, ans, score, yes, ok FROM c)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold quality, two model verdicts by length thresholds, role by language."""
    j = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", F.col("lang").alias("role"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 500).alias("pred_a"), (F.col("n_chars") >= 900).alias("pred_b"), F.col("n_chars").alias("score"), "toxic")


P = "p AS (SELECT doc_id, lang AS role, quality = 1 AS gold, n_chars >= 500 AS pred_a, n_chars >= 900 AS pred_b, n_chars AS score, toxic FROM documents JOIN labels USING (doc_id))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("run"), F.concat("l_returnflag", "l_linestatus").alias("role"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"))


R = "r AS (SELECT l_orderkey AS q, l_suppkey AS run, l_returnflag || l_linestatus AS role, l_linenumber * 100000 + l_partkey AS pos FROM lineitem)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: each vector is a sequence, each component's size an entropy, its label by place."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    return e.select(F.col("vec_id").alias("seq"), F.col("label").alias("batch"), "pos", F.abs(x).alias("entropy"), F.exp(-x).alias("ce"), F.when(F.col("pos") < 8, -100).otherwise((F.col("pos") * 7 + F.col("vec_id")) % 50).cast("int").alias("label"))


T = "t AS (SELECT vec_id AS seq, label AS batch, i - 1 AS pos, abs(embedding[i]::DOUBLE) AS entropy, exp(-embedding[i]::DOUBLE) AS ce, CASE WHEN i <= 8 THEN -100 ELSE ((i - 1) * 7 + vec_id) % 50 END AS label FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"

#: Text of a made-up teacher answer, by what is left of the document's number.
TAILS = (
    "\nVerification: Is the answer correct (Yes/No)? Yes", "\nEarliest Error: the step is\n wrong in arithmetic\nVerification: Is the answer correct (Yes/No)? No", "\nFinal Verdict: no", "\nFinal Answer: None", "", " so yes, then no #### 1,234.50 ", "\n\\boxed{\\frac{1}{2}}", "\n<final_verdict>No</final_verdict> $12,000.00.",
)


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of whole texts and a tail; question and solution are the whole text."""
    j = texts(spark, sf_dir, "doc_id", "text", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("doc_id") % len(TAILS) + 1).cast("int"))
    return j.select(
        F.concat(F.lit("row-"), F.col("doc_id").cast("string")).alias("row_id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 11 == 0, "error").otherwise("ok").alias("status"), F.concat(F.col("text"), tail).alias("answer_text"),
        F.when(F.col("quality") == 1, "TRUE").otherwise("n").alias("candidate_is_correct"), F.col("text").alias("question"), F.col("lang").alias("candidate_role"), F.col("text").alias("candidate_solution"),
    )


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


H = (
    "h AS (SELECT 'row-' || doc_id AS row_id, doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, text || (["
    + ", ".join(literal(t) for t in TAILS)
    + f"])[(doc_id % {len(TAILS)} + 1)::INT] AS answer_text, quality = 1 AS gold, text AS question, lang AS candidate_role, text AS candidate_solution FROM documents JOIN labels USING (doc_id))"
)
