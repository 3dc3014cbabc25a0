"""Step spans of reasoning texts and their token statistics. Spans are struct<s, e, text> in characters, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.entropy import step_stats
from ..functions.text import is_blank, lengths_before, let

HEADER = r"(?miU)(?:^|\n)\s*Step\s+\d+\b"
_SPAN = "array<struct<s:int,e:int,text:string>>"


def _placed(pieces: Column, base: Column | int = 0) -> Column:
    """Spans of pieces that lie end to end."""
    base = F.lit(base) if isinstance(base, int) else base
    starts = lambda p: lengths_before(F.transform(p, lambda x: F.length(x).cast("long")))

    def spans(p: Column) -> Column:
        place = lambda x: (x["at"] + base).cast("int")
        return F.transform(F.arrays_zip(p.alias("p"), starts(p).alias("at")), lambda x: F.struct(place(x).alias("s"), (place(x) + F.length(x["p"])).alias("e"), x["p"].alias("text")))

    return let(pieces, spans).cast(_SPAN)


def _not_blank(spans: Column) -> Column:
    return F.filter(spans, lambda x: ~is_blank(x["text"]))


def header_spans(text: Column) -> Column:
    """[G2 W14] From each `Step n` header to the next; what stands before the first is a span unless blank. Null without headers."""

    def spans(x: Column) -> Column:
        heads, gaps = x["heads"], x["gaps"]
        parts = F.concat(F.slice(gaps, 1, 1), F.transform(heads, lambda h, i: F.concat(h, F.get(gaps, i + 1))))
        placed = F.filter(_placed(parts), lambda y: y["e"] > y["s"])
        first_is_head = F.get(gaps, F.lit(0)) == ""
        return F.when(F.size(heads) > 0, F.filter(placed, lambda y: (y["s"] > 0) | first_is_head | ~is_blank(y["text"])))

    # the text is cut once, not again for each header
    return let(F.struct(F.regexp_extract_all(text, F.lit(HEADER), F.lit(0)).alias("heads"), F.split(text, HEADER, -1).alias("gaps")), spans)


def paragraph_spans(text: Column) -> Column:
    """[G3] Blocks between blank lines, without the break; blank blocks go; the whole text if none is left."""
    brk = r"(?U)\n\s*\n+"
    gaps = F.split(text, brk, -1)
    breaks = F.concat(F.regexp_extract_all(text, F.lit(brk), F.lit(0)), F.array(F.lit("")))
    both = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), breaks.alias("b")), lambda x: F.array(x["g"], x["b"])))
    kept = _not_blank(F.filter(_placed(both), lambda x, i: i % 2 == 0))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e"), text.alias("text")))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))


def sentence_spans(text: Column, base: Column | int = 0) -> Column:
    """[G4] Sentences with their end marks and the white space behind; a tail is a span of its own."""
    return _placed(F.regexp_extract_all(text, F.lit(r"(?dsU).*?[.!?]+(?:\s+|\z)|.+\z"), F.lit(0)), base)


def reasoning_spans(text: Column) -> Column:
    """[G1] By step headers, else by paragraphs if there are several, else by sentences within the only one."""
    def by_sentence(paragraphs: Column) -> Column:
        only = paragraphs[0]
        return let(_not_blank(sentence_spans(only["text"], only["s"])), lambda found: F.when(F.size(found) > 0, found).otherwise(paragraphs))

    def without_headers(paragraphs: Column) -> Column:
        return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(by_sentence(paragraphs))

    blocks = F.when(text.rlike(HEADER), header_spans(text)).otherwise(let(paragraph_spans(text), without_headers))
    return F.when(text == "", F.array().cast(_SPAN)).otherwise(blocks)


def token_span(s: Column, e: Column, n_chars: Column, n_tokens: Column) -> Column:
    """[G5] struct<t0, t1>: characters to tokens in proportion, floor and ceiling, kept in range, widened by a token if empty.

    An empty character span gives an empty token span at the nearest token (halves to even)."""
    s, e = (F.greatest(F.lit(0), F.least(x, n_chars)).cast("long") for x in (s, e))  # products of two lengths don't fit an int
    pair = lambda a, b: F.struct(a.cast("int").alias("t0"), b.cast("int").alias("t1"))
    mid = F.least(n_tokens, F.greatest(F.lit(0), F.bround(s * n_tokens / n_chars, 0).cast("int")))
    t0 = F.least(n_tokens, F.floor(s * n_tokens / n_chars).cast("int"))
    t1 = F.least(n_tokens, F.ceil(e * n_tokens / n_chars).cast("int"))
    wide = pair(t0, F.when((t1 == t0) & (t1 < n_tokens), t1 + 1).otherwise(t1))
    return F.when(n_tokens <= 0, pair(F.lit(0), F.lit(0))).when(n_chars <= 0, pair(F.lit(0), F.least(F.lit(1), n_tokens))).when(e <= s, pair(mid, mid)).otherwise(wide)


def step_features(spans: Column, entropies: Column, n_chars: Column) -> Column:
    """[G6 J10] Steps with token range and entropy statistics; without tokens (0, 0) and NaN.

    A step costs what its own tokens cost: the text is measured once, and tokens are fetched by place, as `slice` copies the whole array first."""

    def among(e: Column, t0: Column, t1: Column) -> Column:
        return F.when(t1 > t0, F.transform(F.sequence(t0, t1 - 1), lambda i: F.get(e, i))).otherwise(F.array().cast("array<double>"))

    def step(row: Column, x: Column) -> Column:
        e, n_chars = row["e"], row["n_chars"]
        n = F.size(e)
        none = F.struct(F.lit(0).alias("t0"), F.lit(0).alias("t1"))

        def of(t: Column) -> Column:
            stats = lambda st: F.struct(t["t0"].alias("start_token"), t["t1"].alias("end_token"), *[st[k].alias(f"{k}_entropy") for k in ("mean", "max", "min", "std")])
            return let(step_stats(among(e, t["t0"], t["t1"])), stats)

        return let(F.when(n > 0, token_span(x["s"], x["e"], n_chars, n)).otherwise(none), of)

    return let(F.struct(entropies.cast("array<double>").alias("e"), n_chars.alias("n_chars")), lambda row: F.transform(spans, lambda x: step(row, x)))


def segment(text: Column, entropies: Column) -> Column:
    """[G7] Steps of one reasoning text with its token entropies."""
    return step_features(reasoning_spans(text), entropies, F.length(text))
