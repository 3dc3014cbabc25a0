"""Queries see texts to their end: plain versions over a made-up folder of tables."""

import re

import pytest

from tracelens.functions import prompts
from tracelens.plans import queries, views

LONG = "many words of prose " * 250
TEXTS = [
    LONG, LONG + "the end", LONG + "x", "short", LONG + "\nEarliest Error: wrong arithmetic in step two\nVerification: Is the answer correct (Yes/No)? No", LONG + "\nFinal Verdict: Yes", " " * 120 + "late words",
    LONG + "but the last number is 1,234.50 of them", LONG, "\n".join([LONG] * 3), LONG + "ß É", "Upper  " * 30, LONG + "\nFinal Verdict: no\n####  42 ",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def by_id(df):
    return {int(str(r[0]).removeprefix("row-")): r for r in df.collect()}


def test_teacher_rows_hold_whole_texts(spark, folder):
    full = {i: t + views.TAILS[i % len(views.TAILS)] for i, t in enumerate(TEXTS)}
    rows = {r.pos: r for r in views.teacher(spark, folder).collect()}
    assert {i: (r.answer_text, r.question, r.candidate_solution) for i, r in rows.items()} == {i: (full[i], t, t) for i, t in enumerate(TEXTS)}
    got = by_id(queries.QUERIES["verdict_parse"](spark, folder))
    # verdicts and errors that only the text past its beginning holds
    assert (got[4].teacher, got[4].error, got[5].teacher, got[12].teacher) == ("No", "wrong arithmetic in step two", "Yes", "No")
    assert by_id(queries.QUERIES["answer_extract"](spark, folder))[12].answer == "42"
    reasons = by_id(queries.QUERIES["filter_cascade"](spark, folder))
    assert reasons[6].reject_reason == "rationale_too_short" and reasons[5].verdict == "Yes"
    clean = {int(r.id.removeprefix("row-")): r for r in queries.QUERIES["clean_projection"](spark, folder).collect()}
    assert clean and all(r.verification_rationale == full[i].strip() and r.candidate_solution == TEXTS[i] for i, r in clean.items())
    sft = by_id(queries.QUERIES["sft_examples"](spark, folder))
    assert all(f"Candidate reasoning:\n{t[:3000]}\n\nCandidate final answer" in sft[i].prompt for i, t in enumerate(TEXTS))
    asked = by_id(queries.QUERIES["verify_messages"](spark, folder))
    assert all(asked[i].user_text == f"Question:\n{t}\n\nCandidate Solution:\n{t}\n\n{prompts.VERIFY}" for i, t in enumerate(TEXTS))
    assert {i: r.prompt for i, r in by_id(queries.QUERIES["prompt_fill"](spark, folder)).items()} == {i: f"Q: {t} [en] {t}" for i, t in enumerate(TEXTS)}
    report = queries.QUERIES["final_report"](spark, folder).first()
    assert report.mean_chars == pytest.approx(sum(map(len, full.values())) / len(full), abs=1e-6)


def light(t):
    t = re.sub(r"[$,\\]", "", t.strip().lower()).strip()
    words = t.split()
    if len(words) <= 10:
        return t
    bare = [w.strip(".,!?;:()") for w in reversed(words)]
    return next((w for w in bare if re.sub(r"[./-]", "", w).isdigit()), words[-1])


def test_light_form_is_of_the_whole_text(spark, folder):
    got = by_id(queries.QUERIES["answer_norm_light"](spark, folder))
    assert {i: r.form for i, r in got.items()} == {i: light(t) for i, t in enumerate(TEXTS)}
    assert (got[7].form, got[1].form) == ("1234.50", "end")


def test_question_key_is_of_the_whole_text(spark, folder):
    got = by_id(queries.QUERIES["clean_text"](spark, folder))
    assert {i: r.question_norm for i, r in got.items()} == {i: " ".join(t.split()).lower() for i, t in enumerate(TEXTS)}
    assert got[0].question_norm != got[1].question_norm
