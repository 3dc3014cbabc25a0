"""Training-loss semantics as queries over token rows and columns. A label of -100 is no target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import at_place

IGNORE = -100


def masked_labels(ids: Column, prompt_len: Column, max_len: int, pad_to: int | None = None) -> Column:
    """[L1] Labels: ids cut to `max_len`, those of the prompt and the padding ignored."""
    cut = F.slice(ids, 1, max_len)
    labels = F.transform(cut, lambda x, i: F.when(i < prompt_len, F.lit(IGNORE)).otherwise(x))
    return labels if pad_to is None else F.concat(labels, F.array_repeat(F.lit(IGNORE), F.greatest(F.lit(0), F.lit(pad_to) - F.size(labels))))


def kept_completion(prompt: Column, completion: Column, max_len: int) -> Column:
    """[L2] Prompt and completion within `max_len`: the prompt loses its beginning. Where nothing may be left of the prompt all of it stays and the end is cut."""
    room = F.lit(max_len) - F.size(completion)
    n = F.least(room, F.size(prompt))
    tail = F.when(room > 0, F.when(n > 0, F.slice(prompt, F.greatest(F.size(prompt) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))).otherwise(prompt)).otherwise(prompt)
    return F.slice(F.concat(tail, completion), 1, max_len)


def shifted(df: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label") -> DataFrame:
    """[L3 F15] Each row's target: the next row's label; rows without a target go."""
    return df.withColumn("target", F.lead(label).over(Window.partitionBy(seq).orderBy(pos))).where(F.col("target").isNotNull() & (F.col("target") != IGNORE))


def top_share(df: DataFrame, share: float, seq: str = "seq", pos: str = "pos", entropy: str = "entropy") -> DataFrame:
    """[W11] Marks the max(1, floor(n * share)) tokens of highest entropy of each sequence."""
    w = Window.partitionBy(seq)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * F.lit(float(share))))
    return df.withColumn("mask", F.row_number().over(w.orderBy(F.desc(entropy), pos)) <= k)


def quantiles(df: DataFrame, quantile: float, batch: str, value: str) -> DataFrame:
    """batch, _q, _n: the exact quantile of each batch's values, by linear interpolation, and how many there are.

    The two values that it lies between are found by `at_place`, which counts values in ranges first, so a batch may be of any size."""
    known = df.where(F.col(value).isNotNull()).select(batch, value)
    stats = known.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_at", (F.col("_n") - 1) * F.lit(float(quantile)))
    ends = [at_place(known, stats.select(batch, f(F.col("_at")).cast("long").alias("_place"), "_lo", "_hi"), batch, value).withColumnRenamed(value, name) for f, name in ((F.floor, "_low"), (F.ceil, "_high"))]
    both = stats.join(ends[0], batch).join(ends[1], batch)
    between = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    return both.select(batch, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("_q"), "_n")


def quantile_mask(df: DataFrame, quantile: float = 0.8, batch: str = "batch", entropy: str = "entropy") -> DataFrame:
    """[W12] Marks tokens at or above the batch's entropy quantile; all of a batch of one."""
    q = quantiles(df, quantile, batch, entropy)
    return df.join(q, batch).withColumn("mask", (F.col("_n") <= 1) | (F.col(entropy) >= F.col("_q"))).drop("_q", "_n")


def weights(entropy_share: Column, mask: Column | None = None, target: Column | None = None, verdict_ids: tuple[int, ...] = (), alpha: float = 0.05, extra: float = 0.5, verdict_weight: float = 2.0) -> Column:
    """[L5 L6 L7] 1 + alpha * normalised entropy, more on marked tokens, times the verdict weight on verdict tokens."""
    w = F.lit(1.0) + entropy_share * alpha
    if mask is not None:
        w = w + F.when(mask, F.lit(extra)).otherwise(0.0)
    if target is not None and verdict_ids:
        w = w * F.when(target.isin(*verdict_ids), F.lit(verdict_weight)).otherwise(1.0)
    return w


def weighted_loss(df: DataFrame, ce: str, weight: Column, by: list[str] | None = None) -> DataFrame:
    """[A37 L9] Sum of weighted cross entropies over the count of targets; weights of 1 give the plain mean."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg((F.sum(F.col(ce) * weight) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("loss"), F.count(F.lit(1)).alias("n_valid"))


def masked_loss(df: DataFrame, ce: str, mask: str = "mask", by: list[str] | None = None) -> DataFrame:
    """[L8] Mean cross entropy over marked tokens."""
    m = F.col(mask).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg((F.sum(F.col(ce) * m) / (F.sum(m) + 1e-8)).alias("loss"), F.sum(m).cast("long").alias("n_marked"))
