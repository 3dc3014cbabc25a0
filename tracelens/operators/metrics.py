"""Metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import score_form
from ..functions.text import is_blank, strip


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def counts(pred: Column, gold: Column) -> list[Column]:
    """tp, fp, fn, tn of booleans."""
    return [F.count_if(pred & gold).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(~pred & gold).alias("fn"), F.count_if(~pred & ~gold).alias("tn")]


def with_scores(df: DataFrame) -> DataFrame:
    """[A12] accuracy, precision, recall, f1 (0 where undefined) from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification(df: DataFrame, pred: Column, gold: Column, by: list[str] | None = None) -> DataFrame:
    """[A11 A12 A13] One row, or one a group, of counts and scores."""
    return with_scores((df.groupBy(*by) if by else df).agg(*counts(pred, gold), F.count(F.lit(1)).alias("n")))


def value_counts(df: DataFrame, *cols: str, nulls: bool = True) -> DataFrame:
    """[A9 A10 A15 A20 A31]"""
    df = df if nulls else df.dropna(subset=list(cols))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def group_sizes(df: DataFrame, q: str) -> DataFrame:
    """[A15] How many groups have how many rows."""
    return df.groupBy(q).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """[A14 A11] Counts per row and value, 0 where there is none, and percent of the row."""
    t = df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values])
    total = sum((F.col(f"n_{v}") for v in values[1:]), F.col(f"n_{values[0]}"))
    return t.select("*", *[ratio(F.col(f"n_{v}") * 100.0, total).alias(f"pct_{v}") for v in values])


def oracle_any(df: DataFrame, q: str = "q", ok: str = "ok", index: str = "idx") -> DataFrame:
    """[A17 A18 A19 A33] Best-of-n accuracy, share of questions with a right candidate of index 0, and mean and deviation of a random choice, exactly.

    An index counts as 0 if its text is `0`. Without any question all are 0."""
    first = F.bool_or(F.col(ok) & F.coalesce(F.col(index).cast("string") == "0", F.lit(False)))
    per = df.groupBy(q).agg(F.bool_or(ok).alias("any_ok"), F.coalesce(first, F.lit(False)).alias("first_ok"), F.avg(F.col(ok).cast("double")).alias("p"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per.agg(
        F.count(F.lit(1)).alias("n_questions"), mean(F.col("any_ok").cast("double")).alias("oracle"), mean(F.col("first_ok").cast("double")).alias("pass_at_1"), mean("p").alias("random_mean"),
        F.coalesce(F.sqrt(F.sum(F.col("p") * (1 - F.col("p")))) / F.count(F.lit(1)), F.lit(0.0)).alias("random_std"),
    )


def first_candidate(candidates: DataFrame, q: str = "q", index: str = "idx", pos: str = "pos", pred: str = "pred") -> DataFrame:
    """q, first: the prediction of each question's candidate of index 0, else of its first candidate."""
    order = F.struct(~F.coalesce(F.col(index) == 0, F.lit(False)), F.col(pos))
    return candidates.groupBy(q).agg(F.min_by(F.coalesce(pred, F.lit("")), order).alias("first"))


def filled_direct(samples: DataFrame, candidates: DataFrame, q: str = "q", direct: str = "direct", **names: str) -> DataFrame:
    """[H11] Samples whose empty direct prediction is filled from candidate 0; `filled` marks them."""
    first = first_candidate(candidates, q, **names).withColumnRenamed("first", "_first")
    empty = F.coalesce(F.col(direct), F.lit("")) == ""
    use = empty & ~is_blank(F.col("_first"))
    out = samples.join(first, q, "left").withColumn("filled", use)
    return out.withColumn(direct, F.when(F.col("filled"), strip(F.col("_first"))).otherwise(F.col(direct))).drop("_first")


def direct_accuracy(samples: DataFrame, gold: str = "gold", direct: str = "direct") -> DataFrame:
    """[A1] Accuracy over the rows with a direct prediction, by scoring normal forms; null if there is none."""
    kept = samples.where(F.coalesce(F.col(direct), F.lit("")) != "")
    return kept.agg(F.avg((score_form(F.col(gold)) == score_form(F.col(direct))).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cot_accuracy(samples: DataFrame, candidates: DataFrame, q: str = "q", gold: str = "gold", **names: str) -> DataFrame:
    """[A2] Accuracy of candidate 0 (else the first) over the questions with candidates; 0 if there is none."""
    both = samples.select(q, gold).join(first_candidate(candidates, q, **names), q)
    right = (score_form(F.col(gold)) == score_form(F.col("first"))).cast("double")
    return both.agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def parse_metrics(df: DataFrame, pred: Column, gold: Column, formatted: Column) -> DataFrame:
    """[A22 A27] Parse rate, format rate, accuracy with unparsed as wrong, and among parsed."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    right = F.coalesce(pred == gold, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n"), (F.count(pred) / n).alias("parse_rate"), (F.count_if(formatted) / n).alias("format_rate"), (F.count_if(right) / n).alias("strict_accuracy"),
        ratio(F.count_if(right), F.count(pred)).alias("parsed_accuracy"),
    )


def threshold_sweep(df: DataFrame, score: str, gold: Column, thresholds: list[float]) -> DataFrame:
    """[A35] Scores at each threshold, yes meaning score >= threshold.

    Each row falls into the bin of how many thresholds it reaches; rows are summed per bin before they
    meet, and running sums over the few bins give every threshold. Rows and thresholds are never paired."""
    marks = sorted(set(map(float, thresholds)))
    x = F.col(score).cast("double")
    at = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= x))
    bins = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum(gold.cast("long")).alias("p"))
    every = df.sparkSession.createDataFrame(list(enumerate(marks, 1)), "bin int, threshold double")
    bins = bins.join(every, "bin", "full_outer").select("bin", "threshold", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("p", F.lit(0)).alias("p"))
    up, all_of = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    k = bins.select("threshold", F.sum("c").over(up).alias("n_yes"), F.sum("p").over(up).alias("tp"), F.sum("p").over(all_of).alias("all_p"), F.sum("c").over(all_of).alias("all_c")).where("threshold is not null")
    k = k.select("threshold", "n_yes", "tp", (F.col("n_yes") - F.col("tp")).alias("fp"), (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_c") - F.col("n_yes") - (F.col("all_p") - F.col("tp"))).alias("tn"))
    return with_scores(k).select("threshold", "precision", "recall", "f1", "n_yes")


def transitions(df: DataFrame, kind: str = "transition") -> DataFrame:
    """[A32] Count and share of each transition."""
    return value_counts(df, kind).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def bootstrap(df: DataFrame, value: str, n_boot: int, key: str = "i", seed: int = 1) -> DataFrame:
    """[A23 J12] Means of `n_boot` resamples of the rows, numbered 0.. by `key`. boot, mean.

    Draw j of resample b is row (1103515245 * (b * n + j + seed) + 12345) % 2**31 % n: an arithmetic that any engine can repeat.
    The draws of a resample are a table of n_boot * n small rows joined on the row number, summed before they meet."""
    n = df.count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "boot long, mean double")
    draws = spark.range(n_boot * n).select(F.floor(F.col("id") / n).alias("boot"), F.pmod(F.pmod(F.lit(1103515245) * (F.col("id") + seed) + 12345, F.lit(1 << 31)), F.lit(n)).alias(key))
    return draws.groupBy("boot", key).agg(F.count(F.lit(1)).alias("k")).join(df.select(key, F.col(value).cast("double").alias("v")), key).groupBy("boot").agg((F.sum(F.col("k") * F.col("v")) / n).alias("mean"))


def interval(boots: DataFrame, mean: str = "mean") -> DataFrame:
    """[A24 A25] 95 % interval by percentiles, mean, and the share that is not above 0."""
    return boots.agg(F.avg(mean).alias("mean"), F.percentile(mean, 0.025).alias("ci_low"), F.percentile(mean, 0.975).alias("ci_high"), F.avg((F.col(mean) <= 0).cast("double")).alias("p_le_0"))


def efficiency(df: DataFrame, by: str, q: str = "q") -> DataFrame:
    """[A26] Verifier calls and calls per question."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("verifier_calls"), F.count_distinct(q).alias("n_questions")).withColumn("calls_per_q", F.col("verifier_calls") / F.col("n_questions"))


def stacked(**parts: DataFrame) -> DataFrame:
    """[A38] One-row metrics under each other, named."""
    frames = [df.select(F.lit(name).alias("method"), "*") for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def self_agreement(df: DataFrame, raw: Column, normal: Column) -> DataFrame:
    """[A34] How often a raw prediction's normal form is its stored normal form; this is not accuracy against gold."""
    return df.agg(F.avg((raw == normal).cast("double")).alias("direct_self_agreement"), F.count(F.lit(1)).alias("n"))
