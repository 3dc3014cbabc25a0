"""Verdict parsing, labels, the error taxonomy and transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash, strip

#: Fixed patterns of verdict lines, by priority.
TEACHER = (
    r"(?iU)Verification:\s*Is\s+the\s+answer\s+correct\s*\(Yes/No\)\?\s*(Yes|No)",
    r"(?iU)Is\s+the\s+answer\s+correct\s*\(Yes/No\)\?\s*(Yes|No)",
    r"(?iU)Final\s+Verdict\s*:\s*(Yes|No)",
    r"(?iU)Final\s+Answer\s*:\s*(Yes|No)",
)
EVALUATION = (
    r"(?iU)Verification:\s*Is the answer correct\s*\(Yes/No\)\?\s*(Yes|No)",
    r"(?iU)Is the answer correct\s*\(Yes/No\)\?\s*(Yes|No)",
    r"(?iU)Final\s*(?:Answer|Grade|Verdict)?\s*[:\-]?\s*(Yes|No)",
)
EARLIEST_ERROR = (
    r"(?isU)Earliest\s+Error\s*:\s*(.+?)(?:\n\s*Verification:|\z)",
    r"(?isU)earliest\s+fatal\s+error\s*(?:is|:)?\s*(.+?)(?:\n\s*Verification:|\z)",
)
#: Fixed taxonomy: class and keywords, in order.
TAXONOMY = (
    ("Generalization / variable error", ("variable", "general formula", "instead of", "undefined")),
    ("Wrong formula", ("formula", "incorrect formula", "wrong formula")),
    ("Arithmetic error", ("arithmetic", "calculation", "computes", "miscalculate")),
    ("Problem misinterpretation", ("setup", "misunderstand", "misinterpret", "incorrect assumption")),
    ("Reasoning / logic error", ("step", "logic", "reasoning", "incorrect reasoning")),
    ("Incorrect conclusion", ("final answer", "conclusion", "answer", "result")),
)


def _first(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def teacher_verdict(c: Column) -> Column:
    """[P13] Yes, No or null; no word end is asked for, so `None` reads as No."""
    return F.initcap(_first(c, TEACHER))


def evaluation_verdict(c: Column) -> Column:
    """[P17] As above by other patterns, else the last word yes or no."""
    words = F.regexp_extract_all(c, F.lit(r"(?iU)\b(yes|no)\b"), F.lit(1))
    return F.initcap(F.coalesce(_first(c, EVALUATION), F.try_element_at(words, F.lit(-1))))


def tag_verdict(c: Column) -> Column:
    """[P18] The tag's verdict; else Yes if the word yes is anywhere, else No if no is."""
    t = F.lower(strip(F.coalesce(c, F.lit("None"))))
    tag = F.nullif(F.regexp_extract(t, r"(?U)<final_verdict>\s*(yes|no)\s*</final_verdict>", 1), F.lit(""))
    return F.coalesce(F.initcap(tag), F.when(t.rlike(r"(?U)\byes\b"), "Yes").when(t.rlike(r"(?U)\bno\b"), "No"))


def earliest_error(c: Column) -> Column:
    """[P14] The first error named, white space folded; null if none is."""
    return squash(_first(c, EARLIEST_ERROR))


def verdict_to_bool(c: Column) -> Column:
    """[P16]"""
    return F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)


def has_format(c: Column) -> Column:
    """[P19]"""
    return F.coalesce(c.rlike(r"(?iU)Verification:\s*Is the answer correct"), F.lit(False))


#: Fixed label keys, in order.
LABEL_KEYS = ("gold_is_correct", "is_correct", "candidate_is_correct")


def truthy(v: Column) -> Column:
    """Python truth of a VARIANT value."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", text != "").when(number.isNotNull(), number != 0).otherwise(~text.isin("[]", "{}"))


def bool_label(record: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    """[P20] Truth of the first key present in a JSON record or its metadata; else whether gold_verdict is yes."""
    v = F.try_parse_json(record)
    picks = []
    for k in keys:
        for path in (f"$.{k}", f"$.metadata.{k}"):
            x = F.try_variant_get(v, path, "variant")
            picks.append(F.when(x.isNotNull(), truthy(x)))
    gold = F.coalesce(F.try_variant_get(v, "$.gold_verdict", "string"), F.try_variant_get(v, "$.metadata.gold_verdict", "string"), F.lit(""))
    return F.coalesce(*picks, F.lower(gold) == "yes")


def gold_verdict(record: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    """[P21] gold_verdict or parsed_final_verdict if Yes or No (record, then metadata), then the truth of the label keys; null if nothing is there."""
    v = F.try_parse_json(record)
    at = lambda p: F.try_variant_get(v, p, "string")
    words = [F.when(at(f"{root}.{k}").isin("Yes", "No"), at(f"{root}.{k}")) for root in ("$", "$.metadata") for k in ("gold_verdict", "parsed_final_verdict")]
    marks = [F.when(x.isNotNull(), F.when(truthy(x), "Yes").otherwise("No")) for k in keys for root in ("$", "$.metadata") for x in [F.try_variant_get(v, f"{root}.{k}", "variant")]]
    return F.coalesce(*words, *marks)


def answer_in_prompt(c: Column) -> Column:
    """[P29] The candidate's final answer as a prompt states it; a blank one takes the next line."""
    return strip(F.regexp_extract(c, r"(?dU)Candidate final answer:\s*(.+)", 1))


def error_class(c: Column) -> Column:
    """[P30] Ordered keyword taxonomy; null, '', 'none' and 'none.' are no error, NaN is Other."""
    t = F.lower(c.cast("string"))
    out = F.when(c.isNull() | strip(t).isin("none", "none.", ""), "No error")
    for name, words in TAXONOMY:
        out = out.when(t.rlike("|".join(words)), name)
    return out.otherwise("Other")


#: Fixed names of what happens between two verdicts on the same case: (first right, second right).
TRANSITIONS = {(True, True): "Both correct", (True, False): "A correct, B broke", (False, True): "A wrong → B fixed", (False, False): "Both wrong"}


def transition(a: Column, b: Column) -> Column:
    """[P31]"""
    return F.when(a & b, TRANSITIONS[True, True]).when(a, TRANSITIONS[True, False]).when(b, TRANSITIONS[False, True]).otherwise(TRANSITIONS[False, False])
