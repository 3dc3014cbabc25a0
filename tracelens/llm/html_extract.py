"""Main text of pages by nearest-URL page differencing.

1. Each page becomes lines: its blocks in page order, references decoded, white space folded. A line carries
   its zone: in an article, in the main part, elsewhere, or in a part that never is main text
   (menus, headers, footers, sidebars, notices, adverts, forms, reader comments).
2. Pages are ordered by host, path, key and a hash of the page, and dealt in ranges of that order. A page's
   neighbours are the nearest pages of its host on either side that aren't copies of it, wherever ranges are cut:
   the pages next to a cut are sent to both sides (one pass over the keys finds them, a few keys for each range).
3. The partner is the neighbour with more of the path in common (the earlier one of equals); one that shares
   `COPY` or more of the page's lines is a copy that differs in little, and the other one is taken.
   The lines of the two are aligned by a longest common subsequence, and shared lines are deleted.
4. The page's own structure checks this: a line in an article or main part stays, as copies and passages of an article on one
   host are shared lines too; where a page has such a part, lines outside it go. Elsewhere differencing alone decides.
5. The text is the lines left, one a line. n_lines counts the page's lines and n_shared those that differencing deletes.

Nulls and empty html: empty text. A null or unreadable URL counts as its own host "". Very long pages are whole and
read in linear time. Repeated rows: one result each, the same one. Ties in the order are full copies, which have the same
neighbours. Pages whose host has no other page keep all lines outside frame parts. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed lists of HTML: elements without content, elements that start a block, elements that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol"
    " option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input math menu nav noframes noscript object option select svg template textarea title".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp template textarea".split())
#: Class, id or role words that mark such parts; the second list only on elements that hold blocks, as the words are common elsewhere.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising breadcrumb breadcrumbs comment comments contentinfo cookie cookies disqus footer nav navbar navigation newsletter pagination"
    " sidebar signup sponsor sponsored subscribe subscription toolbar".split()
)
PART_MARKS = MARKS | frozenset(
    "banner complementary consent gdpr menu modal notice notices popup promo promoted promotion related replies respond search share sharing skip social widget".split()
)
#: Elements for the second list, and words that join with a mark to a compound such as `sidebar-left` or `main-nav`.
PARTS = frozenset("aside center details dialog dir div dl fieldset figure footer form header menu nav ol section table td tr ul".split())
JOINS = frozenset("area bar block bottom box button buttons center column container content form group header inner item items label left links list main mobile outer panel primary post posts right secondary section site small top unit wrap wrapper".split())
#: An article is one of these only by the words of adverts and reader comments.
ARTICLE_MARKS = frozenset("ad ads advert advertisement comment comments reply sponsored".split())
TOP_ONLY = frozenset(["header", "masthead"])
ARTICLE, MAIN, PLAIN, FRAME = 3, 2, 1, 0
#: Share of a page's lines from which on a partner is a copy.
COPY = 0.9
#: Lines compared at once: longest common subsequences of more are found by halves.
CELLS = 1 << 26

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TO_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_SPECIAL = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def marked(tag: str, name: str) -> bool:
    """True if the classes, id or role of a tag say that it is no main text: a mark, or a compound of a mark and joining words."""
    marks = ARTICLE_MARKS if name == "article" else PART_MARKS if name in PARTS else MARKS
    for a in _ATTR.finditer(tag):
        for word in (a[1] or a[2] or a[3] or "").lower().split():
            parts = [x for x in _WORDS.split(word) if x]
            if any(x in marks for x in parts) and all(x in PART_MARKS or x in JOINS or x.isdigit() for x in parts):
                return True
    return False


def top_only(tag: str) -> bool:
    return any(w in TOP_ONLY for a in _ATTR.finditer(tag) for w in (a[1] or a[2] or a[3] or "").lower().split())


class TagEnds:
    """Ends of tags with quoted attributes, each found in the time of a binary search, for pages where a quote isn't closed."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.at) + 1)
        following = {'"': -1, "'": -1}
        for j in range(len(self.at) - 1, -1, -1):
            ch = page[self.at[j]]
            if ch == ">":
                self.ends[j] = self.at[j] + 1
            else:
                close, following[ch] = following[ch], j
                self.ends[j] = self.ends[close + 1] if close >= 0 else -1

    def __call__(self, start: int) -> int:
        return self.ends[bisect_left(self.at, start)]


def parts(page: str) -> Iterator[tuple[str, str]]:
    """(text before, tag) in turn, in linear time; comments and raw elements are left out. A tag whose quotes don't close ends at its first >."""
    at = pos = 0
    last = page.rfind(">") + 1
    ends: TagEnds | None = None
    while m := _OPEN.search(page, pos):
        start, tag = m.start(), ""
        if m[0] == "<!--":
            close = page.find("-->", start + 2)
            end = close + 3 if close >= 0 else len(page)
        elif start >= last:
            pos = start + 1
            continue
        elif m[0] in ("<!", "<?"):
            end = page.find(">", start) + 1
        else:
            whole = _TO_END.match(page, start) if ends is None else None
            if not whole and ends is None:
                ends = TagEnds(page)
            end = whole.end() if whole else ends(start)
            end = end if end > 0 else page.find(">", start) + 1
            tag = page[start:end]
            name = _TAG.match(tag)[1].lower()
            if name in RAW and tag[1] != "/":
                close = _CLOSE[name].search(page, end)
                end, tag = close.end() if close else len(page), ""
        yield page[at:start], tag
        at = pos = end
    yield page[at:], ""


class Stack:
    """Open elements with the zone inside each; every question is answered without going through it."""

    def __init__(self):
        self.names: list[tuple[str, int]] = []
        self.open: Counter = Counter()
        self.lists: list[int] = []  # places of ul, ol, menu and li

    @property
    def zone(self) -> int:
        return self.names[-1][1] if self.names else PLAIN

    def push(self, name: str, zone: int) -> None:
        if name in ("ul", "ol", "menu", "li"):
            self.lists.append(len(self.names))
        self.names.append((name, zone))
        self.open[name] += 1

    def cut(self, place: int) -> None:
        """Closes everything from a place on."""
        while len(self.names) > place:
            self.open[self.names.pop()[0]] -= 1
        while self.lists and self.lists[-1] >= place:
            self.lists.pop()

    def close(self, name: str) -> bool:
        if not self.open[name]:
            return False
        place = len(self.names) - 1
        while self.names[place][0] != name:
            place -= 1
        self.cut(place)
        return True


def lines_of(page: str) -> list[tuple[str, int]]:
    """(line, zone) of a page."""
    out: list[tuple[str, int]] = []
    stack, text, zone = Stack(), [], PLAIN

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, zone))
            text.clear()

    for before, tag in parts(page):
        if before:
            text.append(before)
        if not tag:
            continue
        name = _TAG.match(tag)[1].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if tag[1] == "/":
            if stack.close(name) and zone != stack.zone:
                flush()
                zone = stack.zone
            continue
        if name in VOID or tag.endswith("/>"):
            continue
        if name in BLOCKS and name not in ("html", "body", "head") and stack.close("p"):
            zone = stack.zone
        elif name == "li" and stack.lists and stack.names[stack.lists[-1]][0] == "li":
            stack.cut(stack.lists[-1])
            zone = stack.zone
        new = zone
        if zone != FRAME:
            attributes = "=" in tag
            if name == "body" or name == "html":
                new = PLAIN
            elif name in NEVER or attributes and marked(tag, name) or zone == PLAIN and (name == "header" or attributes and top_only(tag)):
                new = FRAME
            elif name == "article":
                new = ARTICLE
            elif zone == PLAIN and (name == "main" or attributes and _ROLE_MAIN.search(tag)):
                new = MAIN
        if new != zone:
            flush()
            zone = new
        stack.push(name, zone)
    flush()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """After each of b's lines: an integer whose bit p is 0 where the length of the common subsequence grows at a's p-th line."""
    at: dict = {}
    for p, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << p
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _grown(row: int, n: int) -> np.ndarray:
    """Lengths of the common subsequence for each beginning of a, 0..n."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[int]:
    """Places in a, in order, of a longest common subsequence of a and b."""
    if not a or not b:
        return []
    if len(a) * len(b) > CELLS and len(b) > 1:
        # split b in the middle and a where the two parts' lengths add up to most
        half = len(b) // 2
        row = 0
        for row in _rows(a, b[:half]):  # noqa: B007
            pass
        left = _grown(row, len(a))
        for row in _rows(a[::-1], b[half:][::-1]):  # noqa: B007
            pass
        cut = int(np.argmax(left + _grown(row, len(a))[::-1]))
        return common(a[:cut], b[:half]) + [cut + p for p in common(a[cut:], b[half:])]
    rows = [(1 << len(a)) - 1, *_rows(a, b)]
    p, q, out = len(a) - 1, len(b), []
    while p >= 0 and q > 0:
        if rows[q] >> p & 1:
            p -= 1
        elif not rows[q - 1] >> p & 1:
            q -= 1
        else:
            out.append(p)
            p, q = p - 1, q - 1
    return out[::-1]


def shared(a: list, b: list) -> set[int]:
    """Places in `a` of a longest common subsequence with `b`."""
    n, lo = min(len(a), len(b)), 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    keep = set(range(lo)) | set(range(len(a) - hi, len(a)))
    other = set(b[lo : len(b) - hi])
    ia = [i for i in range(lo, len(a) - hi) if a[i] in other]
    mine = {a[i] for i in ia}
    return keep | {ia[p] for p in common([a[i] for i in ia], [x for x in b[lo : len(b) - hi] if x in mine])}


def difference(lines: list[str], zones: list[int], partners: list[list[str]]) -> tuple[str, int]:
    """Main text of a page, and how many lines differencing deletes; partners in order of preference."""
    gone: set[int] = set()
    for p in partners:
        gone = shared(lines, p)
        if len(gone) < COPY * len(lines):
            break
        gone = set()
    best = max((z for z in zones if z >= MAIN), default=PLAIN)
    sure = {i for i, z in enumerate(zones) if z == best != PLAIN}
    gone -= sure
    kept = sure or {i for i, z in enumerate(zones) if z == PLAIN} - gone
    return "\n".join(x for i, x in enumerate(lines) if i in kept), len(gone)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def order(host: str, path: str, key: str | None, digest: int) -> tuple:
    """A row's place in the order of pages, null keys first."""
    return host, path, key is not None, key, digest


def same(a: tuple, b: tuple) -> bool:
    """True for places of full copies on one host."""
    return a[0] == b[0] and a[-1] == b[-1]


def neighbours(ranges: list[dict[str, tuple]]) -> list[tuple[tuple | None, tuple | None]]:
    """For each range, in order, the nearest place before its first row that is no copy of that, and after its last row likewise.

    A range gives its first and last place and, if it has one, the nearest to either that is no copy of it."""

    def walk(rs, near: str, far: str) -> list[tuple | None]:
        out, end, other = [], None, None
        for r in rs:
            place = end if end is not None and not same(end, r[near]) else other
            out.append(place if place is not None and place[0] == r[near][0] else None)
            if f"other_{far}" in r:
                other = r[f"other_{far}"]
            elif end is not None and not same(end, r[far]):
                other = end
            end = r[far]
        return out

    return list(zip(walk(ranges, "first", "last"), walk(ranges[::-1], "last", "first")[::-1], strict=True))


def _ends_of_ranges(keys: DataFrame, n: int) -> list[dict[str, tuple]]:
    """The `n` or fewer ranges of the ordered keys, as `neighbours` takes them: at most four keys each reach the driver."""
    columns = ["host", "path", "ks", "h"]
    arrow = pa.schema([("part", pa.int32()), ("what", pa.string()), ("host", pa.string()), ("path", pa.string()), ("ks", pa.string()), ("h", pa.int64())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str, tuple] = {}
        for b in batches:
            for place in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if not found:
                    found["first"] = found["last"] = place
                    continue
                if "other_first" not in found and not same(place, found["first"]):
                    found["other_first"] = place
                if not same(place, found["last"]):
                    found["other_last"] = found["last"]
                found["last"] = place
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([dict(zip(columns, p, strict=True)) | {"part": part, "what": w} for w, p in found.items()], schema=arrow)

    ordered = keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    by: dict[int, dict[str, tuple]] = {}
    for r in ordered.mapInArrow(ends, "part int, what string, host string, path string, ks string, h long").collect():
        by.setdefault(r["part"], {})[r["what"]] = order(r["host"], r["path"], r["ks"], r["h"])
    return [by[p] for p in sorted(by)]


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", ranges: int | None = None) -> DataFrame:
    """One row per page: key, url, text, n_chars, n_lines, n_shared. The result is the same for any number of `ranges` (default: that of shuffle partitions)."""
    spark = pages.sparkSession
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    html_of = F.coalesce(F.col(f"`{page}`"), F.lit(""))
    src = pages.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{key}`").cast("string").alias("ks"), F.col(f"`{url}`").alias("url"),
        host.alias("host"), path.alias("path"), html_of.alias("page"), F.xxhash64(html_of).alias("h"),
    )
    kind = src.schema["k"].dataType
    key_type, key_name = to_arrow_type(kind), kind.simpleString()
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _ends_of_ranges(src.select("host", "path", "ks", "h"), n)
    firsts = [r["first"] for r in found]
    guests: dict[tuple, list[tuple[int, int]]] = {}
    for i, (before, after) in enumerate(neighbours(found)):
        for role, place in ((0, before), (1, after)):
            if place is not None:
                guests.setdefault(place, []).append((i, role))

    @F.pandas_udf("array<struct<range:int,role:int>>")
    def dealt(host: pd.Series, path: pd.Series, ks: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(host, path, ks, h, strict=True):
            place = order(a, b, None if pd.isna(c) else c, d)
            out.append([(max(0, bisect_right(firsts, place) - 1), 2), *guests.get(place, ())])
        return pd.Series(out)

    rows = src.withColumn("to", F.explode(dealt("host", "path", "ks", "h"))).select("to.range", "to.role", "k", "ks", "url", "host", "path", "h", "page")
    rows = rows.repartitionById(max(n, len(found)), F.col("range")).sortWithinPartitions("range", "role", "host", "path", "ks", "h")
    schema = pa.schema([("k", key_type), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        guest: dict[int, dict] = {}
        before = held = None  # the page before the copies at hand, and these: one page and the rows that hold it

        def finish(after: dict | None) -> None:
            if held is None:
                return
            near = [p or guest.get(role) for role, p in enumerate((before, after))]
            near = [p for p in near if p and p["host"] == held["host"]]
            texts: dict[tuple, tuple[str, int]] = {}
            for r in held["rows"]:
                by_path = sorted(near, key=lambda p: -common_prefix(r["path"], p["path"]))
                choice = tuple(id(p) for p in by_path)
                if choice not in texts:
                    texts[choice] = difference(held["lines"], held["zones"], [p["lines"] for p in by_path])
                text, gone = texts[choice]
                done.append({"k": r["k"], "url": r["url"], "text": text, "n_lines": len(held["lines"]), "n_shared": gone})

        at = None
        for b in batches:
            for i in range(0, b.num_rows, 200):
                for r in b.slice(i, 200).to_pylist():
                    if r["range"] != at:
                        finish(None)
                        at, guest, before, held = r["range"], {}, None, None
                    if held and r["h"] == held["h"] and r["host"] == held["host"]:
                        held["rows"].append({c: r[c] for c in ("k", "url", "path")})
                        held["path"] = r["path"]
                        continue
                    found = lines_of(r["page"])
                    new = {"host": r["host"], "path": r["path"], "h": r["h"], "lines": [t for t, _ in found], "zones": [z for _, z in found]}
                    if r["role"] < 2:
                        guest[r["role"]] = new
                        continue
                    finish(new)
                    before, held = held, new | {"rows": [{c: r[c] for c in ("k", "url", "path")}]}
                    if len(done) >= 200:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done.clear()
        finish(None)
        for i in range(0, len(done), 200):
            yield pa.RecordBatch.from_pylist(done[i : i + 200], schema=schema)

    out = rows.mapInArrow(run, f"k {key_name}, url string, text string, n_lines long, n_shared long")
    return out.select(F.col("k").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
