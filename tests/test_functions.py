"""Column functions against tables of cases."""

import math
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelens.functions import answers, entropy, prompts, text, verdicts
from tracelens.operators import segment


def each(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def table(spark, f, cases, kind="string"):
    got = each(spark, f, [c[0] for c in cases], kind)
    assert [(c[0], g) for c, g in zip(cases, got)] == list(cases)


def test_final_answer(spark):
    table(spark, answers.final_answer, [
        ("", ""), ("  \n ", ""), (None, ""), ("a #### 1 #### 2", "2"), ("x \\boxed{\\frac{1}{2}} y", "\\frac{1}{2}"), ("a\n\\boxed{1", "\\boxed{1"), ("\\boxed{1} \\boxed{2}", "1"), ("a\nb\n\n", "b"), ("one two", "two"),
    ])


def test_gold_form(spark):
    table(spark, answers.gold_form, [
        (None, ""), ("$1,234.00$", "1234"), ("\\frac{\\frac{1}{2}}{3}", "1/2/3"), ("The final answer is: 7.", "7"), ("person", "pern"), ("ﬁ", "fi"), ("１２", "12"), ("-3.0", "-3"), ("3.14", "3.14"), ("12,345,678", "12345678"),
        ("so so so thus 5", "5"), ("\\text{ab} \\left( c", "ab c"), ("ïx", "ïx"), ("a!nswer 5", "answer 5"),
    ])


def test_score_form(spark):
    table(spark, answers.score_form, [
        (None, ""), ("5..", "5"), ("1e5", "100000"), ("1_000", "1000"), ("0.1234567", "0.123457"), ("nan", "nan"), ("inf", "inf"), ("1d", "1d"), ("$1,200.50", "1200.5"), ("Ab C", "Ab C"), ("0x1p3", "0x1p3"), (".5", "0.5"), ("1e999", "1e999"),
    ])


def test_light_form(spark):
    table(spark, answers.light_form, [
        (None, ""), ("(c)", "(c)"), ("\\frac{7}{11}", "frac{7}{11}"), ("a b c d e f g h i j (12.5).", "12.5"), ("a b c d e f g h i j k", "k"), ("$1,000", "1000"),
    ])


def test_verdicts(spark):
    line = "Verification: Is the answer correct (Yes/No)? "
    table(spark, verdicts.teacher_verdict, [(line + "yes", "Yes"), ("Final Answer: None", "No"), ("yes", None), (None, None), ("final verdict : NO", "No")])
    table(spark, verdicts.evaluation_verdict, [(line + "No", "No"), ("yes then no", "No"), ("Final Grade - yes", "Yes"), ("nope", None), (None, None)])
    table(spark, verdicts.tag_verdict, [("<final_verdict> no </final_verdict> yes", "No"), ("no yes", "Yes"), ("No.", "No"), ("x", None), (None, None)])
    table(spark, verdicts.earliest_error, [("Earliest Error: a\n b\n Verification: x", "a b"), ("Earliest error: tail\n", "tail"), ("none here", None)])
    table(spark, verdicts.error_class, [(None, "No error"), ("None.", "No error"), ("None. Because", "Other"), ("wrong formula", "Wrong formula"), ("general formula", "Generalization / variable error"), ("a miscalculated step", "Arithmetic error")])
    assert each(spark, verdicts.error_class, [float("nan")], "double") == ["Other"]


def test_labels_from_records(spark):
    table(spark, verdicts.bool_label, [('{"is_correct": "false"}', True), ('{"gold_is_correct": null}', False), ('{"metadata": {"is_correct": 0}}', False), ('{"gold_verdict": "Yes"}', True)])
    table(spark, verdicts.gold_verdict, [('{"gold_verdict": "Yes"}', "Yes"), ('{"gold_verdict": "maybe", "is_correct": []}', "No"), ('{"metadata": {"parsed_final_verdict": "No"}}', "No"), ("{}", None)])


def test_text(spark):
    table(spark, text.clean_whitespace, [("a \r\nb\t\r c  ", "a\nb\n c"), (" x ", "x"), (None, None)])
    table(spark, text.bool_from_any, [(" TRUE ", True), ("n", False), ("maybe", None), (None, None)])
    assert each(spark, text.json_safe, [1.0, math.inf, math.nan, None], "double") == [1.0, None, None, None]
    assert each(spark, text.percent, [0.5, 0.12345], "double") == ["50.0%", "12.3%"]
    assert each(spark, lambda c: text.from_percent(text.percent(c)), [0.502], "double") == [0.502]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab \t\n\r.,", max_size=20), min_size=1, max_size=20))
def test_clean_whitespace_is_idempotent(spark, values):
    once = each(spark, text.clean_whitespace, values)
    assert once == each(spark, text.clean_whitespace, once)
    assert once == ["\n".join(x.rstrip() for x in v.replace("\r\n", "\n").replace("\r", "\n").strip().split("\n")).strip() for v in values]


def test_entropy(spark):
    close = lambda a, b: all((math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-9 for x, y in zip(a, b))
    assert close(each(spark, entropy.shannon, [[0.25] * 4, [], [0.0, 0.0], [-1.0, 2.0, math.nan], [1.0, 1.0]], "array<double>"), [math.log(4), math.nan, math.nan, 0.0, math.log(2)])
    assert close(each(spark, entropy.from_logprobs, [[0.0, 0.0], [], [0.0, None]], "array<double>"), [math.log(2), math.nan, 0.0])
    words = each(spark, entropy.word_uniform, ["word", "  "])
    assert abs(words[0][0].entropy - math.log(4)) < 1e-12 and words[0][0].logprob == -words[0][0].entropy and words[1] == []
    one, none = each(spark, entropy.step_stats, [[3.0, math.inf], [math.nan]], "array<double>")
    assert (one.mean, one.std) == (3.0, 0.0) and all(math.isnan(v) for v in none)


#: Texts with the spans that they have, written out.
SPANS = {
    "": [],
    "   ": [(0, 3)],
    "one. two! three": [(0, 5), (5, 10), (10, 15)],
    "...": [(0, 3)],
    "a\n\nb\n\n\nc": [(0, 1), (3, 4), (7, 8)],
    "pre\nStep 1: a\nStep 2: b": [(0, 3), (3, 13), (13, 23)],
    "Step 1 x": [(0, 8)],
    "\n Step 1 x\n\n step 22\ny": [(0, 10), (10, 22)],
    "no marks": [(0, 8)],
    "\n\na. b": [(2, 5), (5, 6)],
    "x. \n\ny": [(0, 3), (5, 6)],
    "a.b. c?! d": [(0, 5), (5, 9), (9, 10)],
    "Stepping 1. ok": [(0, 12), (12, 14)],
    "x. " * 300: [(3 * i, 3 * i + 3) for i in range(300)],
}


def test_spans(spark):
    got = each(spark, segment.reasoning_spans, list(SPANS))
    assert [[(x.s, x.e) for x in g] for g in got] == list(SPANS.values())
    assert all(x.text == t[x.s : x.e] for g, t in zip(got, SPANS) for x in g)


def test_prefixes_go_however_many_there_are(spark):
    table(spark, lambda c: answers.gold_form(c, compatibility=False), [("so " * 50 + "7", "7"), ("s" * 40 + "o" * 40 + "8", "8")])
    table(spark, answers.gold_form, [("\uff11\uff12", "12"), ("the answer is: \uff15.00", "5"), (None, "")])
