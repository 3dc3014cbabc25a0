"""Entropies and statistics over arrays, inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, finite, let, strip

NAN = float("nan")


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def finite_only(a: Column) -> Column:
    """[F14]"""
    return F.filter(a, finite)


def shannon(probs: Column, eps: float = 1e-12) -> Column:
    """[A5] Entropy in nats of what is finite and not negative, made to sum to one; NaN if nothing is left."""
    kept = F.filter(probs, lambda p: finite(p) & (p >= 0))

    def of(x: Column) -> Column:
        h = -_sum(x["kept"], lambda p: F.when(p / x["mass"] > eps, p / x["mass"] * F.ln(p / x["mass"])).otherwise(0.0))
        return F.when(x["mass"] > eps, h + F.lit(0.0)).otherwise(F.lit(NAN))

    return let(kept, lambda k: let(F.struct(k.alias("kept"), _sum(k).alias("mass")), of))


def from_logprobs(logprobs: Column) -> Column:
    """[A6] Entropy of the softmax of log probabilities; a missing one counts as minus infinity, none gives NaN."""
    x = F.transform(logprobs, lambda v: F.coalesce(v, F.lit(float("-inf"))))
    w = let(x, lambda a: let(F.struct(a.alias("a"), F.array_max(a).alias("top")), lambda s: F.transform(s["a"], lambda v: F.exp(v - s["top"]))))
    return F.when(F.size(logprobs) == 0, F.lit(NAN)).otherwise(shannon(w))


def word_uniform(text: Column) -> Column:
    """[A7] Per word: token_index, logprob -ln(length), entropy ln(length)."""
    words = F.filter(F.split(strip(text), rf"(?U){SPACE}+"), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct(i.cast("int").alias("token_index"), (-F.ln(F.length(w).cast("double"))).alias("logprob"), F.ln(F.length(w).cast("double")).alias("entropy")))


def step_stats(values: Column) -> Column:
    """[A8] struct<mean, max, min, std> (population) of the finite values; NaN four times for none."""
    pick = lambda n, c: F.when(n > 0, c).otherwise(F.lit(NAN))

    def of(x: Column) -> Column:
        n, v, mean = x["n"], x["v"], x["mean"]
        std = F.sqrt(_sum(v, lambda y: (y - mean) * (y - mean)) / n)
        return F.struct(pick(n, mean).alias("mean"), pick(n, F.array_max(v)).alias("max"), pick(n, F.array_min(v)).alias("min"), pick(n, std).alias("std"))

    return let(finite_only(values), lambda v: let(F.struct(v.alias("v"), F.size(v).alias("n"), F.when(F.size(v) > 0, _sum(v) / F.size(v)).alias("mean")), of))


def entropy_summary(values: Column) -> Column:
    """[A30] struct<mean, max> of the finite values; NaN for none."""
    return let(step_stats(values), lambda s: F.struct(s["mean"].alias("mean"), s["max"].alias("max")))


def mean_known(values: Column) -> Column:
    """[A3 A4] Mean of the values that aren't null; null for none."""
    return let(F.filter(values, lambda x: x.isNotNull()), lambda v: F.when(F.size(v) > 0, _sum(v) / F.size(v)))


def normalised(logits: Column) -> Column:
    """[L4] Entropy of the softmax of logits over ln of their number."""
    return from_logprobs(logits) / F.ln(F.size(logits).cast("double"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log softmax at the place `target` (from 0)."""
    top = F.array_max(logits)
    return let(top, lambda t: F.ln(_sum(logits, lambda v: F.exp(v - t)))) + top - F.element_at(logits, target.cast("int") + 1)


def token_features(logprobs: Column, entropies: Column) -> Column:
    """[G8] array<struct<token_index, logprob, entropy>>; arrays of different length are an error."""
    same = F.assert_true(F.size(logprobs) == F.size(entropies), F.lit("logprobs and entropies differ in length"))
    zipped = F.transform(F.arrays_zip(logprobs.alias("l"), entropies.alias("e")), lambda x, i: F.struct(i.cast("int").alias("token_index"), x["l"].alias("logprob"), x["e"].alias("entropy")))
    return F.when(same.isNull(), zipped)
