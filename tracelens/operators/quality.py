"""Reject cascades, clean projections and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import FIELDS
from ..functions.text import bool_from_any, finite, first_alias, is_blank, strip
from ..functions.verdicts import earliest_error, teacher_verdict, verdict_to_bool

#: Fixed alias lists of the cascade and the clean projection.
RATIONALE = ["answer_text", "verification_rationale", "rationale"]
SOLUTION = ["candidate_solution_clean", "candidate_solution", "candidate_solution_raw", "generated_solution_clean", "generated_solution", "solution"]
REFERENCE = ["reference_solution_clean", "reference_solution", "reference_solution_raw", "correct_solution"]


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def judged(df: DataFrame, min_chars: int = 80, status_ok: bool = True, need_verdict: bool = True, need_match: bool = True, need_error: bool = False) -> DataFrame:
    """Adds verdict, gold, error and reject_reason (null for rows that pass); the first reason in order counts."""
    text = first_alias(df, RATIONALE)
    verdict = F.initcap(F.coalesce(F.nullif(_has(df, "parsed_final_verdict"), F.lit("")), teacher_verdict(text)))
    label = "candidate_is_correct" if "candidate_is_correct" in df.columns else "is_correct"
    gold = bool_from_any(_has(df, label))
    error = F.coalesce(F.nullif(_has(df, "earliest_error"), F.lit("")), earliest_error(text))
    out = df.withColumns({"_text": text, "verdict": verdict, "gold": gold, "error": error})
    guess = verdict_to_bool(F.col("verdict"))
    rules = [
        (status_ok, ~_has(df, "status").eqNullSafe(F.lit("ok")), "status_not_ok"),
        (True, F.length(strip(F.col("_text"))) < min_chars, "rationale_too_short"),
        (need_verdict, ~F.coalesce(F.col("verdict").isin("Yes", "No"), F.lit(False)), "missing_or_invalid_final_verdict"),
        (need_match, F.coalesce(F.col("gold") != guess, F.lit(False)), "verdict_label_mismatch"),
        (need_error, F.coalesce(~F.col("gold"), F.lit(False)) & is_blank(F.col("error")), "missing_earliest_error_for_wrong"),
    ]
    reason = F.lit(None).cast("string")
    for on, failed, name in reversed(rules):
        reason = F.when(failed, name).otherwise(reason) if on else reason
    return out.withColumn("reject_reason", reason)


def clean_rows(df: DataFrame) -> DataFrame:
    """[P34] The clean projection of rows that `judged` passes."""
    kept = df.where("reject_reason is null")
    return kept.select(
        first_alias(df, ["row_id", "id", "sample_id"]).alias("id"), F.lit("teacher_generated").alias("source"), first_alias(df, ["dataset", "source_dataset"], "openmathinstruct").alias("dataset"),
        _has(df, "question_norm").alias("question_norm"), first_alias(df, *FIELDS["question"]).alias("question"), first_alias(df, *FIELDS["candidate_role"]).alias("candidate_role"),
        first_alias(df, SOLUTION).alias("candidate_solution"), first_alias(df, *FIELDS["expected_answer"]).alias("expected_answer"), first_alias(df, *FIELDS["candidate_predicted_answer"]).alias("candidate_predicted_answer"),
        first_alias(df, REFERENCE).alias("reference_solution"), strip(F.col("_text")).alias("verification_rationale"), F.col("verdict").alias("final_verdict"), F.col("gold").alias("is_correct"),
        F.col("error").alias("earliest_error"), _has(df, "teacher_model").alias("teacher_model"), _has(df, "run_id").alias("run_id"), _has(df, "row_id").alias("raw_row_id"),
    )


def reject_counts(df: DataFrame) -> DataFrame:
    """[A9]"""
    return df.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def teacher_row(df: DataFrame, prompt: Column, response: Column, model: str, run: str) -> DataFrame:
    """[P35] Raw teacher outputs: the input's names, the prompt and what the response says. `response` is a text column."""
    names = {f: first_alias(df, *spec) for f, spec in FIELDS.items()}
    return df.select(
        F.lit("ok").alias("status"), F.lit(run).alias("run_id"), first_alias(df, ["row_id", "id", "sample_id"]).alias("row_id"), *[c.alias(k) for k, c in names.items()],
        F.lit(model).alias("teacher_model"), prompt.alias("teacher_prompt"), response.alias("answer_text"), teacher_verdict(response).alias("parsed_final_verdict"), earliest_error(response).alias("earliest_error"),
    )


def _issue(check: str, severity: str, when: Column, message: Column | str, candidate: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    index = F.lit(None).cast("int") if candidate is None else candidate.cast("int")
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), text.alias("message"), index.alias("candidate_index")))


def _numbered(a: Column) -> Column:
    """A list of places as text, the first eight and a mark for more."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(a, 1, 8), lambda x: x.cast("string")), ", "), F.lit("]"), F.when(F.size(a) > 8, " …").otherwise(""))


def issues(df: DataFrame) -> DataFrame:
    """[F8 F9 F10 F11 F12] One row per finding of nested samples: sample_id, check, severity, message, candidate_index.

    Candidates are structs of reasoning_text, predicted_answer_raw, tokens (token_index, logprob, entropy) and steps
    (start_token, end_token, mean/max/min/std_entropy). Names of checks and messages are fixed values."""
    sid = F.when(is_blank(F.col("sample_id")), "<missing>").otherwise(F.col("sample_id"))
    sample = [
        _issue("missing_fields", "error", is_blank(F.col("sample_id")), "sample_id is missing or empty"), _issue("missing_fields", "error", is_blank(F.col("dataset")), "dataset is missing or empty"),
        _issue("missing_fields", "warning", is_blank(F.col("question")), "question is empty"), _issue("missing_fields", "warning", F.col("answer_raw").isNull(), "answer_raw is None"),
        _issue("missing_fields", "warning", F.col("answer_raw").isNotNull() & is_blank(F.col("answer_raw")), "answer_raw is empty"),
    ]

    def of_step(n: Column, ci: Column):
        def check(s: Column, si: Column) -> Column:
            a, b = s["start_token"], s["end_token"]
            nan = F.exists(F.array(*[s[f"{k}_entropy"] for k in ("mean", "max", "min", "std")]), lambda v: F.isnan(v))
            at = lambda *t: F.concat(F.lit("step["), si.cast("string"), F.lit("] "), *t)
            mismatch = lambda when, *t: _issue("entropy_mismatch", "warning", when, at(*[x if isinstance(x, Column) else F.lit(x) for x in t]), ci)
            size, some = n.cast("string"), n > 0
            return F.array(
                _issue("nan_values", "warning", some & nan, at(F.lit("entropy stats hold NaN")), ci), mismatch(n == 0, "present but tokens list is empty"),
                mismatch(some & ((a < 0) | (b < 0)), "has negative token span"), mismatch(some & (b < a), "end_token < start_token"),
                mismatch(some & (b > n), "end_token ", b.cast("string"), " > len(tokens)=", size), mismatch(some & (a > n), "start_token ", a.cast("string"), " > len(tokens)=", size),
            )

        return check

    def of_candidate(c: Column, ci: Column) -> Column:
        t = F.coalesce(c["tokens"], F.array().cast("array<struct<token_index:int,logprob:double,entropy:double>>"))
        places = F.transform(t, lambda x: x["token_index"])
        bad = F.transform(F.filter(t, lambda x: ~finite(x["logprob"]) | ~finite(x["entropy"])), lambda x: x["token_index"])
        first = lambda keep: F.get(F.filter(F.transform(places, lambda x, i: F.when(keep(x, i), F.struct(x.alias("v"), i.alias("i")))), lambda x: x.isNotNull()), F.lit(0))
        moved = first(lambda x, i: ~x.eqNullSafe(i.cast("int")))
        again = first(lambda x, i: F.array_position(places, x) <= i)
        found = F.array(
            _issue("empty_outputs", "warning", is_blank(c["reasoning_text"]), "candidate has empty reasoning_text", ci),
            _issue("empty_outputs", "warning", ~is_blank(c["reasoning_text"]) & is_blank(c["predicted_answer_raw"]), "non-empty reasoning but predicted_answer_raw is empty", ci),
            _issue("nan_values", "warning", F.size(bad) > 0, F.concat(F.lit("non-finite token logprob/entropy at indices "), _numbered(bad)), ci),
            _issue("entropy_mismatch", "warning", moved.isNotNull(), F.concat(F.lit("token_index "), moved["v"].cast("string"), F.lit(" at position "), moved["i"].cast("string"), F.lit(" (expected contiguous 0.."), (F.size(t) - 1).cast("string"), F.lit(")")), ci),
            _issue("entropy_mismatch", "warning", again.isNotNull(), F.concat(F.lit("duplicate token_index "), again["v"].cast("string")), ci),
        )
        steps = F.flatten(F.transform(F.coalesce(c["steps"], F.array().cast(_STEPS)), of_step(F.size(t), ci)))
        return F.concat(found, steps)

    every = F.concat(F.array(*sample), F.flatten(F.transform(F.coalesce("candidates", F.array().cast(df.schema["candidates"].dataType)), of_candidate)))
    rows = df.select(sid.alias("sample_id"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x"))
    return rows.select("sample_id", "x.*")


_STEPS = "array<struct<start_token:int,end_token:int,mean_entropy:double,max_entropy:double,min_entropy:double,std_entropy:double>>"


def duplicate_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """[A28] Keys, not blank, that stand more than once."""
    return df.where(~is_blank(F.col(key).cast("string"))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_summary(found: DataFrame) -> DataFrame:
    """[A29] Findings by check and severity."""
    return found.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("n_samples"))


def final_report(df: DataFrame, q: str, text: str, verdict: str, source: str) -> DataFrame:
    """[A36 F18, by their description] Counters of a training table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(q).alias("questions"), F.count_if(is_blank(F.col(text))).alias("empty_texts"), F.count_if(F.coalesce(F.col(verdict) == "Yes", F.lit(False))).alias("yes"),
        F.count_if(F.coalesce(F.col(verdict) == "No", F.lit(False))).alias("no"), F.count_if(~F.coalesce(F.col(verdict).isin("Yes", "No"), F.lit(False))).alias("bad_verdicts"), F.count_distinct(source).alias("sources"),
        F.avg(F.length(text)).alias("mean_chars"),
    )


def with_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows that have a verdict."""
    return df.where(F.col(verdict).isNotNull())


def false_positives(df: DataFrame, verdict: str = "verdict", gold: str = "gold") -> DataFrame:
    """Rows judged Yes that are wrong."""
    return df.where((F.col(verdict) == "Yes") & ~F.col(gold))


def false_negatives(df: DataFrame, verdict: str = "verdict", gold: str = "gold") -> DataFrame:
    """Rows judged No that are right."""
    return df.where((F.col(verdict) == "No") & F.col(gold))


def wrong_only(df: DataFrame, gold: str = "gold") -> DataFrame:
    """Rows that are wrong."""
    return df.where(~F.col(gold))


def by_teacher(df: DataFrame, part: str = "kimi", teacher: str = "teacher_model") -> DataFrame:
    """Rows whose teacher's name holds `part`, in any case of letters; rows without a name go."""
    return df.where(F.coalesce(F.lower(F.col(teacher)).contains(part.lower()), F.lit(False)))
