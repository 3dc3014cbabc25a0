"""From samples to candidates with tokens and steps: responses, entropy modes, backends, and the whole first step as one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import candidate_answer, final_answer, gold_form, nfkc_each
from ..functions.entropy import from_logprobs, word_uniform
from ..functions.text import strip
from ..sources import schemas, tables
from ..streaming import resume
from . import quality, segment

_TOP = "array<struct<token:string,logprob:double>>"
_RESPONSE = f"struct<choices:array<struct<message:struct<content:string>,logprobs:struct<content:array<struct<token:string,logprob:double,top_logprobs:{_TOP}>>>>>>"


def candidate_list(texts: Column, tokens: Column | None = None) -> Column:
    """[P36] Candidates of texts: what each answers, its tokens (an array for each, none by default), no steps yet."""
    texts = F.transform(texts, lambda t: strip(F.coalesce(t, F.lit(""))))
    if tokens is None:
        tokens = F.transform(texts, lambda _: F.array().cast(f"array<{schemas.TOKEN}>"))
    raws = F.transform(texts, final_answer)
    rows = F.arrays_zip(texts.alias("t"), raws.alias("raw"), nfkc_each(raws).alias("folded"), tokens.alias("tokens"))
    no_steps = F.array().cast(f"array<{schemas.STEP}>").alias("steps")

    def made(x: Column) -> Column:
        normal = gold_form(x["folded"], compatibility=False).alias("predicted_answer_normalized")
        return F.struct(x["t"].alias("reasoning_text"), x["raw"].alias("predicted_answer_raw"), normal, x["tokens"].alias("tokens"), no_steps)

    return F.transform(rows, made)


def bare_candidates(texts: Column) -> Column:
    """Candidates of texts for `with_entropy` and `with_steps` alone, without the answers, which cost more than both."""
    none = [F.array().cast(f"array<{kind}>").alias(name) for kind, name in ((schemas.TOKEN, "tokens"), (schemas.STEP, "steps"))]
    return F.transform(texts, lambda t: F.struct(strip(F.coalesce(t, F.lit(""))).alias("reasoning_text"), *none))


def response_candidates(response: Column) -> Column:
    """[G9] Candidates of a chat completion as JSON text: a choice each, with token log probabilities and the entropy of their alternatives."""

    def tokens(choice: Column) -> Column:
        chosen = F.coalesce(choice["logprobs"]["content"], F.array().cast(f"array<struct<token:string,logprob:double,top_logprobs:{_TOP}>>"))
        top = lambda t: F.transform(F.coalesce(t["top_logprobs"], F.array().cast(_TOP)), lambda x: x["logprob"])
        return F.transform(chosen, lambda t, i: F.struct(i.cast("int").alias("token_index"), t["logprob"].alias("logprob"), from_logprobs(top(t)).alias("entropy")))

    choices = F.from_json(response, _RESPONSE)["choices"]
    return candidate_list(F.transform(choices, lambda c: c["message"]["content"]), F.transform(choices, tokens))


def with_entropy(candidates: Column, mode: str) -> Column:
    """[G10] Candidates under an entropy mode: `none` keeps their tokens, `per_word_uniform` makes tokens of their words; another is an error."""
    if mode == "none":
        return candidates
    if mode == "per_word_uniform":
        return F.transform(candidates, lambda c: c.withField("tokens", word_uniform(c["reasoning_text"])))
    raise ValueError(f"unknown entropy mode: {mode!r}")


def with_steps(candidates: Column) -> Column:
    """[G7] Candidates with the steps of their texts."""
    return F.transform(candidates, lambda c: c.withField("steps", segment.segment(c["reasoning_text"], F.transform(c["tokens"], lambda t: t["entropy"]))))


#: [H3] Backends by name; each takes samples and a configuration and adds the column `texts`.
BACKENDS: dict[str, Callable[[DataFrame, tables.GenerationConfig], DataFrame]] = {"echo": tables.echo_candidates}


def make_backend(backend: str | Callable[[str, int], str]) -> Callable[[DataFrame, tables.GenerationConfig], DataFrame]:
    """[H3] A backend by name, or of a callable (question, index) -> text."""
    if callable(backend):
        return lambda samples, config: tables.function_candidates(samples, backend, config)
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend!r}, known are {sorted(BACKENDS)} and callables")
    return BACKENDS[backend]


def step_one(samples: DataFrame, backend: str | Callable[[str, int], str], config: tables.GenerationConfig, mode: str = "none") -> DataFrame:
    """[H4] Samples with the normal form of their answer and with generated, measured and segmented candidates; none are generated for k = 0."""
    out = samples.withColumn("answer_normalized", candidate_answer(F.col("answer_raw"))["normalized"])
    if config.k < 1:
        return out.withColumn("candidates", F.array().cast(f"array<{schemas.CANDIDATE}>"))
    out = make_backend(backend)(out, config).withColumn("candidates", candidate_list(F.col("texts"))).drop("texts")
    return out.withColumn("candidates", with_steps(with_entropy(F.col("candidates"), mode)))


def run_step_one(spark: SparkSession, samples: DataFrame, folder: str, backend: str | Callable[[str, int], str], config: tables.GenerationConfig, mode: str = "none", strict: bool = False) -> DataFrame:
    """[H4 S13-S16] One call from samples to the four tables in `folder`: what the ledger has is left out, findings of the checks are
    returned; with `strict`, a finding that is an error stops the run before anything is written."""

    def process(todo: DataFrame) -> DataFrame:
        return step_one(todo, backend, config, mode)

    if strict and not quality.issues(process(samples)).where("severity = 'error'").isEmpty():
        raise ValueError("the checks found errors")
    resume.write_batch(samples, folder, process)
    done = resume.side_table(spark, folder, "step1_dataset")
    return quality.issues(tables.nulls_to_nan(done))
