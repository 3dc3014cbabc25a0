"""Column functions on strings and loosely typed values (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str methods see it, in Java's Unicode mode.
SPACE = r"[\s\x1c-\x1f]"
#: Line ends as str.splitlines() sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


#: Array elements that are put together at once.
SLICE = 128


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside other lambdas a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lengths_before(lengths: Column) -> Column:
    """For each length the sum of those before it. Slices are summed apart, so that long arrays aren't copied for each element."""

    def ends(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(a, zero, lambda x, n: F.struct((x["at"] + n).alias("at"), F.concat(x["out"], F.array(x["at"])).alias("out")))

    def block(x: Column, a: Column) -> Column:
        return let(ends(a, x["at"]), lambda y: F.struct(y["at"].alias("at"), F.concat(x["out"], F.array(y["out"])).alias("out")))

    def blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SLICE).cast("int")), lambda i: F.slice(a, i * SLICE + 1, SLICE))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("out"))
        return F.flatten(F.aggregate(parts, zero, block)["out"])

    return F.when(F.size(lengths) > 0, let(lengths, blocks)).otherwise(F.array().cast("array<long>"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squash(c: Column) -> Column:
    """White space runs to single spaces, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for null and for texts of white space only; stops at the first other character."""
    return ~F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def clean_whitespace(c: Column) -> Column:
    """[P1] One kind of line end, no white space at line ends or around the text."""
    lines = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(lines, r"(?mUd)[\s\x1c-\x1f&&[^\n]]+$", ""))


def sample_key(prefix: str, split: Column, row: Column) -> Column:
    """[P2] `prefix:split:00042`; `row` is a stored row number."""
    return F.format_string(f"{prefix}:%s:%05d", split, row)


def source_metadata(**parts: Column | str | int) -> Column:
    """[P3] Metadata map of a source row."""
    pairs = [v for k, x in parts.items() for v in (F.lit(k), (x if isinstance(x, Column) else F.lit(x)).cast("string"))]
    return F.create_map(*pairs)


def first_nonempty(*cols: Column, default: str | None = "", stripped: bool = False) -> Column:
    """[P9 P10 P11] The first value that isn't blank, as it stands (or stripped)."""
    picks = [F.when(~is_blank(c.cast("string")), strip(c.cast("string")) if stripped else c.cast("string")) for c in cols]
    return F.coalesce(*picks, F.lit(default))


def first_alias(df: DataFrame, names: list[str], default: str | None = "", stripped: bool = False) -> Column:
    """first_nonempty over those of the names that the table has."""
    cols = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_nonempty(*cols, default=default, stripped=stripped) if cols else F.lit(default)


def stable_id(ids: list[Column], pos: Column, record_json: Column) -> Column:
    """[P12] The first id that isn't empty, else one made of position and content."""
    made = F.format_string("row_%06d_%s", pos, F.substring(F.sha1(record_json), 1, 16))
    return F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids], made)


def bool_from_any(c: Column) -> Column:
    """[P15] true/1/yes/y and false/0/no/n in any case; anything else is null."""
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def json_safe(c: Column) -> Column:
    """[P32] NaN and infinities become null."""
    return F.when(finite(c), c)


def number_or_nan(c: Column, drop_infinite: bool = False) -> Column:
    """[P33] Numbers as doubles, everything else NaN."""
    x = F.coalesce(c.try_cast("double"), F.lit(float("nan")))
    return F.when(finite(x), x).otherwise(F.lit(float("nan"))) if drop_infinite else x


def percent(c: Column) -> Column:
    """[P38] 0.5 as `50.0%`."""
    return F.format_string("%.1f%%", c * 100)


def from_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%$", "").try_cast("double") / 100


def question_key(c: Column) -> Column:
    """[P39] A question as a grouping key: lower case, single spaces."""
    return F.lower(squash(c))


def eta(done: int, total: int, seconds: float) -> str:
    """[P37] Time left of a run, as text."""
    if not done:
        return "--"
    left = round(seconds / done * (total - done))
    h, m = divmod(left // 60, 60)
    return f"{h}h{m:02d}m" if h else f"{m}m{left % 60:02d}s"
