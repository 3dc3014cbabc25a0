"""Operators on pages, vectors and dialogues, and the pipeline, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import ann, chat, html_extract, neardup, queries, stages

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><header>H</header><nav><ul><li>a<li>b</ul></nav><div class='ad'>buy</div><article><h1>Ti&eacute;</h1>"
    "<p>one<br>two &amp; <b>x</b>y<p>three<aside>s</aside><p class=x>fo&nbsp;ur</p></article><div id='comments'><p>c</p></div><form>f</form><footer>&copy; ff</footer>"
)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, lines string")


def test_pages(spark):
    frame = "<div><p>Welcome to the site</p></div>"
    rows = [
        ("http://a.example/x/1", PAGE), ("http://a.example/x/1", PAGE), (None, None), ("nonsense", ""), ("http://a.example/x/2", "<p>open <b>bold"),
        ("http://b.example/p/1", f"<body>{frame}<p>First own text</p></body>"), ("http://b.example/p/2", f"<body>{frame}<p>Second own text</p></body>"), ("http://c.example/", f"<body>{frame}</body>"),
        ("http://d.example/", "<main>" + "<p>long</p>" * 3000 + "</main>"),
    ]
    got = {r.page_id: r for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    text = "Tié\none two & xy\nthree\nfo ur"
    assert [got[i].text for i in range(8)] == [text, text, "", "", "open bold", "First own text", "Second own text", "Welcome to the site"]
    assert got[0].n_chars == len(text) and got[8].text == "\n".join(["long"] * 3000) and got[2].url is None
    assert html_extract.extract_pages(pages(spark, [])).count() == 0


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        kept = sorted(html_extract.shared(a, b))
        it = iter(b)
        assert len(kept) == d[-1][-1] and all(a[i] in it for i in kept)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 32)) * rng.uniform(0.5, 2, (900, 1))
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(2000, None, ""), (2020, [0.0] * 32, ""), (2040, [float("nan")] * 32, ""), (2060, [1.0], ""), (2080, [None] * 32, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string")
    x = np.array([np.array(v, np.float32) for v in x], np.float64)
    got = {}
    for r in ann.nearest_neighbours(df, k=20, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, near in got.items():
        near.sort()
        score = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert [n for n, _, _ in near] == list(range(1, 21)) and q not in {v for _, v, _ in near} and all(abs(s - score[v]) < 1e-9 for _, v, s in near)
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        hits += len(set(want) & {v for _, v, _ in near})
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest_neighbours(few).collect()) == [(0, 1, 3), (0, 2, 20), (20, 1, 0), (20, 2, 3)]
    assert ann.nearest_neighbours(few.limit(0)).count() == 0


def coded_rows(spark, x):
    codes = spark.sparkContext.broadcast(ann.Codes(x))
    rows = spark.createDataFrame([(i, -i, v.tolist(), [i]) for i, v in enumerate(x)], "c1 long, c2 long, v array<double>, ids array<long>")
    return ann.with_codes(rows, codes, x.shape[1]), ann.Codes(x).code(x)


@pytest.mark.parametrize("p", [0, 1])
def test_probes_find_all_within_a_radius(spark, p, monkeypatch):
    monkeypatch.setattr(ann, "CHEAP", 1.0)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 32))
    x[150:] = x[:150] + rng.standard_normal((150, 32)) * rng.choice([0.01, 0.05, 0.1, 0.2], (150, 1))
    coded, code = coded_rows(spark, x)
    far = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    got = {(r.q1, r.c1) for r in ann.probed(coded.where("c1 < 60"), coded, p, 300).collect() if r.d == far[r.q1, r.c1]}
    want = {(q, c) for q in range(60) for c in range(300) if far[q, c] < ann.N_SUB * (p + 1)}
    assert got == want and len(want) > 90


def test_probes_answer_queries_in_clusters(spark):
    """Clusters of near vectors are answered by probes, the rest by reading codes; both as brute force does."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 48))
    x = np.repeat(centres, 30, axis=0) + 0.02 * rng.standard_normal((600, 48))
    x = np.vstack([x, rng.standard_normal((400, 48))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, n_asked int")
    got = {}
    for r in ann.nearest_neighbours(df, k=10, every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.radius))
    assert sum(near[0][2] is not None for q, near in got.items() if q < 600) >= 50 and all(near[0][2] is None for q, near in got.items() if q >= 600)
    hits = 0
    for q, near in got.items():
        score = x @ x[q]
        want = [i for i in np.argsort(-score, kind="stable") if i != q][:10]
        hits += len(set(want) & {v for _, v, _ in near})
    assert hits >= 0.99 * 10 * len(got)


def test_hot_vectors_are_answered_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(ann, "HOT", 5)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 16))
    x[:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest_neighbours(spark.createDataFrame([*rows, rows[2], rows[55]], "vec_id long, embedding array<double>"), k=5, every=2).collect()
    near = {}
    for r in got:
        near.setdefault((r.query_id, r.rank), []).append(r.vec_id)
    for q in range(0, 60, 2):
        score = x @ x[q]
        order = sorted(range(60), key=lambda i: (-round(score[i], 9), i))
        # row 2 stands twice and row 55 too: each of its rows is a candidate, and each is a query
        want = [i for i in order for _ in range(1 + (i in (2, 55))) if i != q][:5]
        assert [near[q, r] for r in range(1, 6)] == [[v] * (1 + (q == 2)) for v in want], q


def test_recall_on_the_test_table(spark):
    """Against brute force on a whole table without structure, where most queries take codes whole."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1"
    try:
        t = pq.read_table(f"{path}/embeddings.parquet")
    except FileNotFoundError:
        pytest.skip("no tables here")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64)
    place, near = {int(i): p for p, i in enumerate(ids)}, {}
    for r in queries.op2_ann(spark, path).collect():
        near.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(near) == sorted(int(i) for i in ids if i % 20 == 0) and all(len(n) == 20 for n in near.values())
    hits = 0
    for q, found in near.items():
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-score, kind="stable")[:20]].tolist()))
        assert all(abs(s - score[place[v]]) < 1e-9 for _, v, s in found)
    assert hits >= 0.97 * 20 * len(near)


def plain_dialogues(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "") for r in rows if r[0] == conv), key=str)
        turns = sorted(turns, key=lambda t: t)
        for p in {t[2] for t in turns} - {"system"}:
            at = 0
            for pos, (_, turn, who, body) in enumerate(turns):
                head = "assistant" if who == p else "system" if who == "system" else f"user name={who}"
                seg = f"<|im_start|>{head}\n{body}<|im_end|>\n"
                out.append((conv, p, pos, at, at + len(seg), at + len(seg) - len(body) - 11 if who == p else None, seg))
                at += len(seg)
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "heavy"), [(2, 2048), (256, 2048), (256, 2), (4, 3)])
def test_perspectives(spark, chunk, heavy, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    monkeypatch.setattr(chat, "HEAVY", heavy)
    monkeypatch.setattr(chat, "PREFIX", 3)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé🙂"), (1, 3, "ann", None), (1, 3, "ann", None), (2, None, None, ""), (None, 5, "x", "y"), (None, 6, "system", "z"), (3, 0, "system", "alone")] + [(4, i, f"p{i % 3}", "t" * i) for i in range(20)]
    rows += [(5, None, "ab"[i % 2], f"text{i % 7}") for i in range(30)] + [(6, 7, "ab"[i % 2], "ä" * (i % 5) + "z") for i in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, p string")
    got = sorted(((r.conv_id, r.perspective, r.pos, r.start, r.end, r.mask_start, r.segment) for r in chat.perspectives(df).collect()), key=str)
    assert got == plain_dialogues(rows)
    for r in chat.perspectives(df).where("mask_start is not null").collect():
        assert r.segment[r.mask_start - r.start : r.mask_end - r.start].endswith("<|im_end|>")
    assert chat.perspectives(df.limit(0)).count() == 0


def test_stages_pass_documents_on(spark, tmp_path):
    """The pipeline's stages on a small corpus: what goes, what stays, and that the rest is unchanged."""
    import corpus_pipeline

    rng = random.Random(8)
    vocab = ["".join(rng.choice(["an", "er", "to", "li", "ma", "so", "ke", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(2500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(40)
    texts = [prose(120) for _ in range(240)]
    toxic = set(range(0, 240, 6))
    for i in toxic:
        texts[i] += " grubzak morvex grubzak"
    texts[1] = f"{prose(40)} {item} {prose(40)}"
    texts[3] = texts[2]
    texts[5] = texts[4] + " more"
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, now, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{d}/out{i}")
        now = spark.read.parquet(f"{d}/out{i}")
        seen.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    clean = [i for i in range(240) if i not in toxic]
    assert seen[0] == clean
    assert seen[1] == [i for i in clean if i not in (3, 5)]
    assert seen[2] == [i for i in seen[1] if i != 1]
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(i) for i in seen[3]) <= 2 and seen[4] == seen[3]
    again = corpus_pipeline.run(spark, d)
    assert sorted(r.doc_id for r in again.collect()) == seen[4]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/out3").collect()}
    assert all(kept[i] == texts[i] for i in kept)
    assert stages.PERCENT == 80 and neardup.BANDS * neardup.ROWS >= 128


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_sql_of_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no tables here")
    db = duckdb.connect()
    for p in d.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, str(d))
        rel = db.sql(sql)
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        got, want = [tuple(r[c] for c in cols) for r in df.collect()], [tuple(r[i] for i in at) for r in rel.fetchall()]
        assert sorted(got, key=str) == sorted(want, key=str), name
    assert F is not None
