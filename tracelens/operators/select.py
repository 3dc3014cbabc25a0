"""Choice of one candidate per question: votes, confidence, filters by verdict, guards.

Tables have one row per candidate with a unique position `pos` in its question `q`. Answers are aggregated
per (question, answer) before a question's answers meet, so a hot question costs little."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: 32-bit words that a generator seeded with 42 gives, in order. A draw among n < 2**32 takes words until the leading bits of one, as
#: many as n has, are less than n; of each word that is so with probability of at least a half.
WORDS = tuple(map(random.Random(42).getrandbits, [32] * 128))


def _draw(n: Column, words: Column) -> Column:
    """struct<place, used> of a draw among n: the place (from 0) and how many of the words it takes."""
    shift = F.lit(32) - F.length(F.bin(n))
    lead = F.transform(words, lambda w: F.floor(w / F.pow(F.lit(2.0), shift)).cast("long"))

    def first(x: Column) -> Column:
        used = F.array_position(F.transform(x, lambda v: v < n), F.lit(True)).cast("int")
        return F.struct(F.get(x, used - 1).alias("place"), used.alias("used"))

    return let(lead, first)


def place_in_pool(n: Column) -> Column:
    """[W18] The place (from 0) that random.Random(42).choice takes among n, as a column."""
    return _draw(n.cast("long"), F.array(*[F.lit(w).cast("long") for w in WORDS]))["place"]


def second_place(first: Column, n: Column) -> Column:
    """[W18] The seeded place of a second draw among n, after a first among `first`."""
    words = F.array(*[F.lit(w).cast("long") for w in WORDS])
    return let(words, lambda w: let(_draw(first.cast("long"), w)["used"], lambda used: _draw(n.cast("long"), F.slice(w, used + 1, len(WORDS)))["place"]))


#: Ranges of positions in which the rows of a question are counted before any of them are ranked.
BINS = 256


def at_place(pool: DataFrame, place: DataFrame, q: str, pos: str) -> DataFrame:
    """Of each question's rows, in the order of `pos`, the one at its place (from 0). `place`: q, _place, _lo, _hi (least and largest pos).

    Rows are counted in ranges of positions first, and only the range that holds the place is ranked, so a question may have any number of rows."""
    x = pool.join(place.withColumnRenamed(q, "_q"), F.col(q).eqNullSafe(F.col("_q"))).drop("_q")
    reach = F.col("_hi").cast("double") - F.col("_lo")
    part = F.when(reach > 0, (F.col(pos).cast("double") - F.col("_lo")) / reach).otherwise(0.0)
    x = x.withColumn("_bin", F.least(F.floor(part * BINS), F.lit(BINS - 1)))
    counts = x.groupBy(q, "_bin", "_place").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(q).orderBy("_bin")) - F.col("_c"))
    found = counts.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_c"))).select(F.col(q).alias("_q"), F.col("_bin").alias("_b"), "_before")
    rows = x.join(found, F.col(q).eqNullSafe(F.col("_q")) & (F.col("_bin") == F.col("_b")))
    i = F.row_number().over(Window.partitionBy(q).orderBy(pos)) - 1
    return rows.withColumn("_i", i).where(F.col("_i") == F.col("_place") - F.col("_before")).drop("_q", "_b", "_i", "_bin", "_lo", "_hi", "_place", "_before")


def answer_counts(df: DataFrame, q: str, ans: str, pos: str, yes: Column | None = None) -> DataFrame:
    """One row per (q, ans): n, first; with `yes` also y_n and y_first of the candidates for which it holds."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(pos).alias("first")]
    if yes is not None:
        aggs += [F.count_if(yes).alias("y_n"), F.min(F.when(yes, F.col(pos))).alias("y_first")]
    return df.groupBy(q, ans).agg(*aggs)


def majority(df: DataFrame, q: str = "q", ans: str = "ans", pos: str = "pos") -> DataFrame:
    """[W1 W2 A21] q, answer, votes, n_tied; ties go to the answer that came first."""
    c = answer_counts(df, q, ans, pos)
    top = c.groupBy(q).agg(F.max_by(F.struct(F.col(ans).alias("a"), "n"), F.struct("n", -F.col("first"))).alias("best"), F.collect_list("n").alias("ns"))
    return top.select(q, F.col("best.a").alias("answer"), F.col("best.n").alias("votes"), F.size(F.filter("ns", lambda x: x == F.col("best.n"))).alias("n_tied"))


def by_confidence(df: DataFrame, q: str = "q", ans: str = "ans", pos: str = "pos", logprob: str = "logprob", entropy: str = "entropy") -> DataFrame:
    """[W3] q, answer: the highest mean log probability (first of equals); if a question has none, the lowest entropy, where a missing entropy wins."""
    best = F.max_by(ans, F.when(F.col(logprob).isNotNull(), F.struct(F.col(logprob), -F.col(pos))))
    calm = F.min_by(ans, F.struct(F.col(entropy).isNotNull(), F.coalesce(F.col(entropy), F.lit(0.0)), F.col(pos)))
    return df.groupBy(q).agg(best.alias("b"), calm.alias("c"), F.count(logprob).alias("k")).select(q, F.when(F.col("k") > 0, F.col("b")).otherwise(F.col("c")).alias("answer"))


def best_run(df: DataFrame, required: list[str], q: str = "q", run: str = "run", role: str = "role", pos: str = "pos") -> DataFrame:
    """[W4 J9 D1] The rows of each question's best run: most required roles covered, then most rows anywhere, then first."""
    has = [F.max(F.coalesce(F.col(role) == r, F.lit(False)).cast("int")) for r in dict.fromkeys(required)]
    cover = sum(has[1:], has[0]) if has else F.max(F.lit(0))
    runs = df.groupBy(q, run).agg(cover.alias("cover"), F.min(pos).alias("first"), F.count(F.lit(1)).alias("m"))
    everywhere = runs.groupBy(run).agg(F.sum("m").alias("freq"))
    best = runs.join(everywhere, run).groupBy(q).agg(F.max_by(run, F.struct("cover", "freq", -F.col("first"))).alias(run))
    return df.join(best, [q, run], "left_semi")


def pool_pick(df: DataFrame, yes: Column, q: str = "q", pos: str = "pos", keep: tuple[str, ...] = ("ans", "ok")) -> DataFrame:
    """[W5 W7] A seeded pick among a question's Yes candidates, else among all; `expected` is the exact mean of ok over the pool."""
    rows = df.withColumn("_yes", F.coalesce(yes, F.lit(False)))
    ok = F.col("ok").cast("double")
    of = lambda c: F.when(F.col("_yes"), c)
    stats = rows.groupBy(q).agg(
        F.bool_or("_yes").alias("_some"), F.count(F.lit(1)).alias("n"), F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.avg(ok).alias("e"),
        F.count_if("_yes").alias("yn"), F.min(of(F.col(pos))).alias("ylo"), F.max(of(F.col(pos))).alias("yhi"), F.avg(of(ok)).alias("ye"),
    )
    pick = lambda a, b: F.when(F.col("_some"), F.col(a)).otherwise(F.col(b))
    stats = stats.select(q, "_some", pick("yn", "n").alias("n"), pick("ylo", "lo").alias("_lo"), pick("yhi", "hi").alias("_hi"), pick("ye", "e").alias("expected"))
    stats = stats.withColumn("_place", place_in_pool(F.col("n"))).drop("n")
    pool = rows.join(stats.select(F.col(q).alias("_s"), F.col("_some").alias("_any")), F.col(q).eqNullSafe(F.col("_s"))).where(F.col("_yes") | ~F.col("_any")).drop("_s", "_any", "_yes")
    name = F.when(F.col("_some"), "yes_pool").otherwise("all")
    return at_place(pool, stats, q, pos).select(q, F.col(pos).alias("chosen_pos"), *keep, "expected", name.alias("strategy"))


def filtered_majority(df: DataFrame, yes: Column, q: str = "q", ans: str = "ans", pos: str = "pos", by_support: bool = True) -> DataFrame:
    """[W6 W8] Vote among Yes candidates, else all; ties by support among all (W6), then by first occurrence."""
    c = answer_counts(df, q, ans, pos, yes)
    any_yes = c.withColumn("some", F.max(F.col("y_n") > 0).over(Window.partitionBy(q)))
    pool_n = F.when(F.col("some"), F.col("y_n")).otherwise(F.col("n"))
    pool_first = F.when(F.col("some"), F.col("y_first")).otherwise(F.col("first"))
    c = any_yes.withColumn("pn", pool_n).withColumn("pf", pool_first).where("pn > 0")
    order = F.struct("pn", *(["n"] if by_support else []), -F.col("pf"))
    return c.groupBy(q).agg(F.max_by(F.struct(F.col(ans).alias("a"), F.col("pn").alias("v"), "some"), order).alias("x")).select(q, F.col("x.a").alias("answer"), F.col("x.v").alias("votes"), F.when(F.col("x.some"), "yes_pool").otherwise("all").alias("strategy"))


def guarded_majority(df: DataFrame, yes: Column, q: str = "q", ans: str = "ans", pos: str = "pos") -> DataFrame:
    """[W9] Majority among Yes candidates, unless the only top answer of all candidates differs from the only top answer of Yes, has two votes and some Yes.

    q, answer, chosen_pos, strategy, global_votes, yes_votes; picks among equals are the seeded ones, in order of first occurrence."""
    c = answer_counts(df, q, ans, pos, yes)
    g = c.groupBy(q).agg(F.max("n").alias("g_max"), F.max("y_n").alias("y_max"), F.array_sort(F.collect_list(F.struct("first", F.col(ans).alias("a"), "n", "y_n", "y_first"))).alias("all"))
    g_top = F.filter("all", lambda x: x["n"] == F.col("g_max"))
    y_top = F.array_sort(F.transform(F.filter("all", lambda x: (x["y_n"] == F.col("y_max")) & (F.col("y_max") > 0)), lambda x: F.struct(x["y_first"].alias("first"), x["a"].alias("a"), x["n"].alias("n"), x["y_n"].alias("y_n"))))
    g = g.select(q, "g_max", "y_max", g_top.alias("g_top"), y_top.alias("y_top"))
    guard = (F.size("y_top") == 1) & (F.size("g_top") == 1) & ~F.get("y_top", F.lit(0))["a"].eqNullSafe(F.get("g_top", F.lit(0))["a"]) & (F.col("g_max") >= 2) & (F.get("g_top", F.lit(0))["y_n"] > 0)
    name = F.when(F.col("y_max") == 0, "B_no_yes_global").when(guard, "B_conflict_guard_global").otherwise("B_yes_majority")
    g = g.withColumn("strategy", name)
    of_all = F.col("strategy") != "B_yes_majority"
    answer = F.when(of_all, F.get("g_top", place_in_pool(F.size("g_top")))["a"]).otherwise(F.get("y_top", place_in_pool(F.size("y_top")))["a"])
    tied = F.when(F.col("strategy") == "B_conflict_guard_global", F.lit(0)).when(of_all, F.size("g_top")).otherwise(F.size("y_top"))
    g = g.select(q, answer.alias("answer"), "strategy", tied.alias("tied"))
    # the candidate within the answer: a further draw where an answer was drawn, the only one after a guard
    rows = df.withColumn("_yes", yes).join(g.withColumnRenamed(q, "_q"), F.col(q).eqNullSafe(F.col("_q")) & F.col(ans).eqNullSafe(F.col("answer"))).where((F.col("strategy") != "B_yes_majority") | F.col("_yes"))
    n = F.count(F.lit(1)).alias("n")
    stats = rows.groupBy(q, "tied").agg(n, F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    place = F.when(F.col("tied") == 0, place_in_pool(F.col("n"))).otherwise(second_place(F.greatest(F.col("tied"), F.lit(1)), F.col("n")))
    picked = at_place(rows.drop("_q", "_yes"), stats.select(q, place.alias("_place"), "_lo", "_hi"), q, pos)
    votes = c.select(F.col(q).alias("_q2"), F.col(ans).alias("_a2"), F.col("n").alias("global_votes"), F.col("y_n").alias("yes_votes"))
    out = picked.join(votes, F.col(q).eqNullSafe(F.col("_q2")) & F.col("answer").eqNullSafe(F.col("_a2")))
    return out.select(q, "answer", F.col(pos).alias("chosen_pos"), "strategy", "global_votes", "yes_votes")


def support_filtered(df: DataFrame, yes: Column, q: str = "q", ans: str = "ans", pos: str = "pos", margin: str = "score") -> DataFrame:
    """[W10, experimental: only its results are known] Among Yes answers with two votes or more the highest margin, else the vote of all."""
    c = df.groupBy(q, ans).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"), F.max(F.when(yes, F.col(margin))).alias("m"))
    good = (F.col("m").isNotNull()) & (F.col("n") >= 2)
    order = F.struct(good, F.when(good, F.col("m")).otherwise(F.col("n").cast("double")), F.col("n"), -F.col("first"))
    return c.groupBy(q).agg(F.max_by(F.struct(F.col(ans).alias("a"), good.alias("g")), order).alias("x")).select(q, F.col("x.a").alias("answer"), F.when(F.col("x.g"), "conf_support2").otherwise("fallback_global_majority").alias("strategy"))


def first_rows(df: DataFrame, n: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """[W13 S22] The first n rows in order, of all or of each group; a negative n gives none."""
    if not group:
        return df.orderBy(*order).limit(max(0, n))
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def all_but_last(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """What rows[:-n] keeps."""
    return df.orderBy(*order).limit(max(0, df.count() - n))


#: [§2.12] Strategies by name; each takes candidates and a Yes column and gives one row per question.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "majority": lambda df, yes: majority(df),
    "naive": pool_pick,
    "filtered_majority": filtered_majority,
    "filtered_majority_plain": lambda df, yes: filtered_majority(df, yes, by_support=False),
    "guarded_majority": guarded_majority,
    "support_filtered": support_filtered,
}
