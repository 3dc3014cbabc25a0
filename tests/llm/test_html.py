"""Main text of pages: against plain versions, whatever the ranges, in linear time."""

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from tracelens.llm import html_extract as h

SF = Path("/root/testdata/sf0.01")


class Plain(HTMLParser):
    """Blocks of text in the article, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines, self.at = 0, [], []

    def end_block(self):
        line = " ".join("".join(self.at).split())
        if line and self.inside:
            self.lines.append(line)
        self.at = []

    def handle_starttag(self, tag, attrs):
        if tag in h.BLOCKS:
            self.end_block()
        elif tag == "br":
            self.at.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in h.BLOCKS:
            self.end_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.at.append(data)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_all_pages_against_a_plain_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p.close()
        want[r.page_id] = "\n".join(p.lines)
    rows = h.extract_pages(pages, ranges=7).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) and r.n_shared <= r.n_lines for r in rows)


def site(rng, n=300):
    """Pages without an article: a frame for each of a few hosts, own lines, copies under other paths and keys."""
    rows, frames = [], [[f"frame {s} line {i}" for i in range(6)] for s in range(3)]
    for i in range(n):
        s = min(rng.randrange(5), 2)
        if rows and rng.random() < 0.4:
            page = rng.choice(rows[-40:])[2] if rng.random() < 0.5 else rows[0][2]
        else:
            own = [f"own {i} {j}" for j in range(rng.randrange(1, 4))]
            page = "".join(f"<p>{x}</p>" for x in frames[s][:3] + own + frames[s][3:])
        rows.append((f"k{i}", f"http://h{s}.example/{rng.choice('abc')}/{rng.randrange(40)}", page))
    return rows + [("k7", rows[7][1], rows[7][2]), (None, None, None), (None, "http://h1.example/a", "<p>alone</p>")]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def plain_texts(rows):
    """For each row: its lines less those that a page of the same host next to it shares."""
    place = lambda r: ((r[1] or "").split("/")[2] if r[1] else "", "/" + "/".join((r[1] or "").split("/")[3:]) if r[1] else "", r[0] is not None, r[0] or "", r[2] or "")
    ordered, out = sorted(rows, key=place), {}
    for i, r in enumerate(ordered):
        lines = [x for x in (r[2] or "").replace("</p>", "").split("<p>") if x]
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(ordered) and place(ordered[j])[0] == place(r)[0] and (ordered[j][2] or "") == (r[2] or ""):
                j += step
            if 0 <= j < len(ordered) and place(ordered[j])[0] == place(r)[0]:
                near.append(ordered[j])
        near.sort(key=lambda o: -h.common_prefix(place(o)[1], place(r)[1]))
        kept = lines
        for o in near:
            other = [x for x in (o[2] or "").replace("</p>", "").split("<p>") if x]
            if lcs(lines, other) < h.COPY * len(lines):
                kept = [x for x in lines if x not in other]
                break
        out[r[0], r[1]] = ("\n".join(kept), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("ranges", [1, 8, 60, 211])
def test_differencing_is_the_same_for_any_ranges(spark, ranges):
    rows = site(random.Random(11))
    want = plain_texts(rows)
    got = h.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string"), ranges=ranges).collect()
    assert len(got) == len(rows) and {(r.page_id, r.url): (r.text, r.n_shared) for r in got} == want
    # frames are found by differencing alone
    assert sum(r.n_shared for r in got) > 1000 and not any("frame" in r.text for r in got if r.n_shared)


def test_null_keys_of_numbers(spark):
    rows = [(None, "http://a.example/1", "<p>f</p><p>x</p>"), (2**60 + 1, "http://a.example/2", "<p>f</p><p>y</p>"), (2**60, "http://a.example/3", "<p>f</p><p>z</p>")]
    got = h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), ranges=5).collect()
    assert {(r.page_id, r.text) for r in got} == {(None, "x"), (2**60 + 1, "y"), (2**60, "z")}


def test_class_words_of_text_and_of_frames():
    text = lambda page: [x for x, z in h.lines_of(page) if z != h.FRAME]
    assert text('<p class="market share">a</p><p class="ad-hoc">b</p><article class="article related">c<p class="notice">d</p></article>') == ["a", "b", "c", "d"]
    assert text('<div class="share-buttons">a</div><div class="ad">b</div><p class="cookie-notice">c</p><div id="sidebar-left">d</div><article class="comment">e</article><section class="related">f</section>') == []


def test_a_main_part_and_nested_lists():
    assert h.lines_of("<main><ul><li>a<li>b<ul><li>c</ul><li>d</ul></main><p>e") == [("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 1)]


@pytest.mark.parametrize("piece", ['<a href="x>y', "<b>", "<b><li></li>", "<!-- ", "<a ", "<script ", "<![CDATA[", "&am", "</p><p>'", "<ul><li><span>", "<p title='a\">b"])
def test_hostile_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    h.lines_of(page)
    assert time.perf_counter() - began < 20


def test_long_alignments_are_found_by_halves(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(h, "CELLS", 20)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        kept, it = h.common(a, b), iter(b)
        assert len(kept) == lcs(a, b) and kept == sorted(set(kept)) and all(a[i] in it for i in kept)
