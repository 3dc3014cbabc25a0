"""Joins by key, complete groups, group-aware splits, balances and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def nested(samples: DataFrame, candidates: DataFrame, key: str = "sample_id", order: str = "candidate_index", pos: str | None = None) -> DataFrame:
    """[J1] Samples with their candidates as an ordered array; orphans go, and of samples of one key the last by `pos` stays."""
    fields = [c for c in candidates.columns if c != key]
    packed = candidates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("candidates"))
    if pos:
        samples = samples.groupBy(key).agg(F.max_by(F.struct(*[c for c in samples.columns if c != key]), pos).alias("x")).select(key, "x.*")
    return samples.join(packed, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(packed.schema["candidates"].dataType)))


def overlay(base: DataFrame, over: DataFrame, key: str, column: str, pos: str) -> DataFrame:
    """[J2] `column` replaced by the overlay's last value that isn't blank; unknown keys go."""
    last = over.where(~is_blank(F.col(column))).groupBy(key).agg(F.max_by(column, pos).alias("_new"))
    return base.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: str | None) -> DataFrame:
    """[J3 J4] A value by key, or a default. Spark picks the join by the size of the table."""
    one = table.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(one, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """[J5 J12] Rows of both sides on null-safe keys, values as value_a and value_b."""
    left = a.select(*keys, F.col(value).alias(f"{value}_a"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias(f"{value}_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, on).drop(*[f"_{k}" for k in keys])


def common_keys(key: str, *tables: DataFrame) -> DataFrame:
    """[J6] Keys that all tables have."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.distinct()


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """[J6 J8]"""
    return df.join(keys.select(key), key, "left_semi")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """[F13 J7] What the ledger doesn't have. Do this before any generator."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def complete(df: DataFrame, q: str, size: int, at_least: bool = False) -> DataFrame:
    """Rows of groups of exactly (or at least) `size` rows."""
    n = df.groupBy(q).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n.where(F.col("_n") >= size if at_least else F.col("_n") == size), q, "left_semi")


def both_kinds(df: DataFrame, q: str, ok: str, least: int = 2) -> DataFrame:
    """Rows of groups with `least` right and `least` wrong rows."""
    good = df.groupBy(q).agg(F.count_if(F.col(ok)).alias("_r"), F.count_if(~F.col(ok)).alias("_w")).where((F.col("_r") >= least) & (F.col("_w") >= least))
    return df.join(good, q, "left_semi")


def pool_filter(df: DataFrame, text: str, q: str, least: int = 20, most: int = 4096) -> DataFrame:
    """[F16] Texts of `least` to `most` characters, once per question."""
    return df.where(~is_blank(F.col(text)) & F.length(text).between(least, most)).dropDuplicates([q, text])


def unit_hash(key: Column, seed: int = 42) -> Column:
    """An order of keys that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def group_split(df: DataFrame, q: str, parts: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = ("train", "valid", "test"), seed: int = 42) -> DataFrame:
    """[D2 S23] Whole groups to splits, in hash order. Test first takes ceil(share), as a split of a split does.

    A group's place is the count of keys in earlier hash prefixes and within its own, so that no task orders all keys."""
    keys = df.select(q).distinct().withColumn("_h", unit_hash(F.col(q), seed)).withColumn("_p", F.substring("_h", 1, 3))
    sums = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sums.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    placed = keys.join(before, "_p").withColumn("_i", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", q)) - 1)
    rest = F.ceil(F.col("_n") * F.lit(round(1 - parts[0], 12)))
    test = F.ceil(rest * F.lit(round(parts[2] / (parts[1] + parts[2]), 12)))
    name = F.when(F.col("_i") < F.col("_n") - rest, names[0]).when(F.col("_i") < F.col("_n") - test, names[1]).otherwise(names[2])
    return df.join(placed.select(q, name.alias("split")), q)


def leaks(df: DataFrame, q: str, split: str = "split") -> DataFrame:
    """[J11] Groups that stand in more than one split; none is right."""
    return df.groupBy(q).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def balanced(df: DataFrame, by: list[str], label: str, most: int = 50_000, seed: int = 42, key: str = "id") -> DataFrame:
    """[D4, by its description] At most `most` rows of each group, and of each label as many as of its rarest, in hash order.

    Rows are counted by the beginning of their hash first, and ranked within it, so that no task orders a whole group."""
    x = df.withColumn("_h", unit_hash(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    counts = x.groupBy(*by, label, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by, label).orderBy("_p")) - F.col("_c")
    n = counts.groupBy(*by, label).agg(F.sum("_c").alias("_n")).groupBy(*by).agg(F.min("_n").alias("_m"), F.count(F.lit(1)).alias("_k"))
    quota = F.least(F.col("_m"), F.floor(F.lit(most) / F.col("_k")))
    places = counts.withColumn("_b", before).join(n, by).where(F.col("_b") < quota).select(*by, label, "_p", "_b", quota.alias("_quota"))
    rank = F.col("_b") + F.row_number().over(Window.partitionBy(*by, label, "_p").orderBy("_h", key))
    return x.join(places, [*by, label, "_p"]).withColumn("_i", rank).where(F.col("_i") <= F.col("_quota")).select(*df.columns)


def mixture(parts: list[tuple[DataFrame, float]], dedup: list[str], key: str, seed: int = 42) -> DataFrame:
    """[D5, by its description] Shares of tables by hash of the key, one row for equal `dedup` columns (the smallest key)."""
    scale = 1 << 32
    kept = [df.where(F.conv(F.substring(unit_hash(F.col(key), seed), 1, 8), 16, 10).cast("long") < int(share * scale)) for df, share in parts]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    rest = [c for c in out.columns if c not in dedup]
    return out.groupBy(*dedup).agg(F.min_by(F.struct(*rest), key).alias("_x")).select(*[F.col(c) if c in dedup else F.col(f"_x.{c}").alias(c) for c in out.columns])


def row_numbers(df: DataFrame, key: str, name: str, chunk: int = 4096) -> DataFrame:
    """Rows numbered from 0 in the order of a whole-number key: chunks of keys are counted first, and rows are ranked within their chunk."""
    x = df.withColumn("_chunk", F.floor(F.col(key) / chunk))
    counts = x.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(F.col("_chunk").alias("_of"), (F.sum("_c").over(Window.orderBy("_chunk")) - F.col("_c")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_chunk").orderBy(key)) - 1
    return x.join(before, F.col("_chunk").eqNullSafe(F.col("_of"))).withColumn(name, (F.col("_b") + rank).cast("long")).drop("_chunk", "_of", "_b")


def token_set_ratio(a: Column, b: Column) -> Column:
    """[D3] Shared words of two texts as percent of the words of both, by sets (Dice)."""
    x, y = F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+"))
    return F.size(F.array_intersect(x, y)) * 200.0 / (F.size(x) + F.size(y))


def packs(wrong: DataFrame, right: DataFrame, q: str = "q", text: str = "text", low: float = 60, high: float = 98) -> DataFrame:
    """[D3, by its description] Per question: two right ones, the wrong one most like the first right one within [low, high] (subtle), and another wrong one (random)."""
    w = Window.partitionBy(q)
    r = right.withColumn("_i", F.row_number().over(w.orderBy("pos"))).where("_i <= 2")
    first = r.where("_i = 1").select(q, F.col(text).alias("_first"))
    scored = wrong.join(first, q).withColumn("similarity", token_set_ratio(F.col(text), F.col("_first")))
    subtle_first = F.row_number().over(w.orderBy(F.desc(F.col("similarity").between(low, high)), F.desc("similarity"), "pos"))
    v = scored.withColumn("_i", subtle_first).where("_i <= 2").withColumn("candidate_role", F.when((F.col("_i") == 1) & F.col("similarity").between(low, high), "subtle_wrong").otherwise("random_wrong"))
    r = r.withColumn("candidate_role", F.concat(F.lit("correct_"), F.col("_i").cast("string"))).withColumn("similarity", F.lit(None).cast("double"))
    return r.select(q, "pos", "candidate_role", "similarity").unionByName(v.select(q, "pos", "candidate_role", "similarity"))
