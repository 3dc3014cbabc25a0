"""Answer extraction and three normal forms of answers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import LINE_END, SPACE, let, squash, strip

#: Fixed patterns: phrases that the gold normal form takes out wherever they stand.
PREFIXES = (
    r"the\s+final\s+answer\s+is\s*:?\s*",
    r"the\s+answer\s+is\s*:?\s*",
    r"final\s+answer\s*:?\s*",
    r"answer\s*:?\s*",
    r"therefore\s*,?\s*",
    r"thus\s*,?\s*",
    r"hence\s*,?\s*",
    r"so\s*,?\s*",
    r"we\s+get\s*:?\s*",
    r"we\s+have\s*:?\s*",
    r"which\s+(?:is|equals?)\s*:?\s*",
    r"this\s+(?:is|equals?)\s*:?\s*",
    r"giving\s*:?\s*",
    r"equals?\s*:?\s*",
    r"=\s*",
)


def boxed(c: Column) -> Column:
    """[P5] What stands in the first \\boxed{...}, braces balanced; null if there is none or it doesn't end."""
    key = "\\boxed{"
    rest = F.split(F.substr(c, F.instr(c, key) + len(key)), "")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n")))

    end = F.aggregate(rest, start, step)
    inner = F.substr(c, F.instr(c, key) + len(key), end["n"] - 1)
    return F.when(F.instr(c, key) > 0, F.when(end["depth"] == 0, inner))


def final_answer(c: Column) -> Column:
    """[P4] After the last ####, else the first box, else the last line that isn't blank; '' for blank texts."""
    raw = strip(F.coalesce(c, F.lit("")))
    lines = F.filter(F.transform(F.split(raw, LINE_END), strip), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    return F.when(raw == "", "").when(raw.contains("####"), strip(F.substring_index(raw, "####", -1))).otherwise(F.coalesce(strip(boxed(raw)), last))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(s: pd.Series) -> pd.Series:
    """Compatibility forms folded in each text of an array; lambdas can't hold `nfkc`."""
    return s.map(lambda a: None if a is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in a])


def _passes(c: Column, n: int, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), c, lambda acc, _: step(acc))


def until_settled(c: Column, step) -> Column:
    """`step`, which only ever takes characters away, until it takes none: as many passes at the most as the text has characters."""

    def once(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(let(step(a["text"]), lambda x: F.struct(x.alias("text"), (x == a["text"]).alias("done"))))

    passes = lambda x: F.aggregate(F.sequence(F.lit(0), F.length(x)), F.struct(x.alias("text"), F.lit(False).alias("done")), once)["text"]
    return let(c, passes)


def gold_form(c: Column, compatibility: bool = True) -> Column:
    """[P6] The gold normal form. `compatibility` folds Unicode compatibility forms, which takes an Arrow UDF."""
    s = strip(F.coalesce(c, F.lit("")))
    s = F.lower(nfkc(s) if compatibility else s)
    s = _passes(s, 8, lambda x: F.regexp_replace(x, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1/$2"))
    s = F.replace(s, F.lit("$"), F.lit(""))
    s = F.regexp_replace(s, r"(?U)\\(?:left|right|middle)\b", "")
    s = F.regexp_replace(s, r"\\[,;:!]", " ")
    s = F.regexp_replace(s, r"\\text\{([^{}]+)\}", "$1")
    s = F.regexp_replace(s, r"\\mathrm\{([^{}]+)\}", "$1")
    s = F.regexp_replace(s, r"(?U)(\d),(?=\d)", "$1")
    phrases = "(?iU)" + "|".join(f"(?:{p})" for p in PREFIXES).replace(r"\s", SPACE)
    s = until_settled(s, lambda x: F.regexp_replace(F.regexp_replace(x, phrases, ""), rf"(?U)^{SPACE}+", ""))
    s = squash(F.regexp_replace(s, rf"(?U)[^\w\s\x1c-\x1f/.+\-]", ""))
    s = squash(F.regexp_replace(s, r"(?U)(-?\d+)\.0+(?=\s|$)", "$1"))
    return F.regexp_replace(s, r"(?U)(-?\d+)\.(?=\s*$)", "$1")


def score_form(c: Column) -> Column:
    """[P7] The scoring normal form: numbers as shortest text of six decimals at most, other texts without $ , and last dots."""
    t = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[$,]", ""))
    t = strip(F.regexp_replace(t, r"\.+$", ""))
    number = t.rlike(r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$")
    x = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    whole = F.abs(x - F.rint(x)) < 1e-9
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
    as_int = F.rint(x).try_cast("decimal(38,0)").cast("string")
    usable = number & x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    return F.when(usable & whole, F.coalesce(as_int, t)).when(usable, plain).otherwise(t)


def light_form(c: Column) -> Column:
    """[P8] The light normal form: lower case without $ , and backslash; of over ten words the last number, else the last word."""
    t = strip(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"[$,\\]", ""))
    words = F.filter(F.split(t, rf"(?U){SPACE}+"), lambda w: w != "")
    digits = F.filter(words, lambda w: w.rlike(r"(?U)\d"))  # only these can be numbers
    bare = F.transform(F.reverse(digits), lambda w: F.regexp_replace(w, r"^[.,!?;:()]+|[.,!?;:()]+$", ""))
    numbers = F.filter(bare, lambda w: F.regexp_replace(w, r"[./-]", "").rlike(r"(?U)^\d+$"))
    last = F.coalesce(F.try_element_at(numbers, F.lit(1)), F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.when(F.size(words) > 10, last).otherwise(t)


def candidate_answer(c: Column, compatibility: bool = True) -> Column:
    """[P36] struct<raw, normalized> of a reasoning text."""
    raw = final_answer(strip(F.coalesce(c, F.lit(""))))
    return F.struct(raw.alias("raw"), gold_form(raw, compatibility).alias("normalized"))
