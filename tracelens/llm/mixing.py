"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Sizes: words per document, summed per source. Targets by water filling: sources share
   `share` times all words by weight; no source gets over `most` times its size, and what is
   over is shared again by weight.
2. Blocks: the documents of a source are shuffled (order of an md5 of key and seed) and laid
   end to end; every `block` words are a block, and the line repeats for each further pass.
3. Schedule: slot k takes the point k * golden ratio modulo 1. The points fall into the
   sources' cumulative slot shares; a slot's rank within its source is the block it takes. Ranks
   that the points leave out (a block or two per source) come at the end, ranks beyond a
   source's target fall away, and the last block is cut where the target is reached.
4. Slots and blocks are joined on (source, rank); a document's taken words are the words of
   its pieces in scheduled blocks.

Hot sources: running sums and ranks are taken in two steps (sums of small chunks, then within
a chunk), and a source's chunks, blocks and slots spread over tasks by (source, chunk) and
(source, rank). Only one row per source and per chunk meets in a window over more.

Nulls: a null text has 0 words; a null source is a source of its own, last in order; null
keys are documents like others. Empty texts: size 0, taken 0. Ties in the shuffle are broken
by key and size; fully equal rows are interchangeable. Repeated rows count as documents of their own.
Empty table: empty result. Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, quoted

#: Fixed parameters of a mix.
WEIGHTS, SHARE, MOST, BLOCK, CHUNK = (3, 1, 2), 1.5, 2, 1024, 1024
#: Documents of a source in a chunk of its line, about.
ROWS = 256
#: 2**32 times 1 - 1/phi, to the nearest odd integer: k times it modulo 2**32 is a golden-ratio point, in exact long arithmetic.
GOLDEN, RING = 1640531527, 1 << 32
_BINS = 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, sid (place by code point, null last), source_size, n_docs, target (double)."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.orderBy(F.col("source").isNull(), "source")
    src = src.select("*", (F.row_number().over(every) - 1).cast("int").alias("sid"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("sid") % len(weights) + 1)
    src = src.select("*", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    # water level at each source in the order in which sources fill up; those before it are full
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    whole = Window.partitionBy()
    src = src.select(
        "*",
        (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))).alias("full"),
        F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
        (F.sum("source_size").over(whole) * share).alias("all_words"),
    )
    src = src.withColumn("level", (F.col("all_words") - F.coalesce("full", F.lit(0.0))) / F.col("open_w"))
    src = src.withColumn("is_full", F.col("cap") / F.col("w") <= F.col("level"))
    src = src.withColumn("level", F.min(F.when(~F.col("is_full"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(whole)["level"])
    return src.select("source", "sid", "source_size", "n_docs", F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def running(df: DataFrame, group: list[str], chunks: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group before this row. Rows are ordered by the first of `chunks`, then `order`.

    `chunks` go from fine to coarse, each a coarser cut of the same order: the sums of the coarsest meet in one window per group,
    those of finer ones in a window per coarser chunk, rows in a window per finest chunk."""
    fine = chunks[0]
    df = df.withColumn("_v", value)
    sums = df.groupBy(*group, *chunks).agg(F.sum("_v").alias("_s"))
    if len(chunks) > 1:
        sums = running(sums, group, chunks[1:], [F.col(fine)], F.col("_s"), "_b")
    else:
        before = Window.partitionBy(*group).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, fine).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums.select(*group, fine, F.col("_b").alias("_before")), [*group, fine])
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_before")


def schedule(src: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Slots of the mix: sid, rank (from 0), slot (place in the mix). `src` has sid and quota (words, long)."""
    spark = src.sparkSession
    src = src.select("sid", F.ceil(F.col("quota") / block).cast("long").alias("n_slots")).where("n_slots > 0")
    total = src.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    upto = Window.orderBy("sid")
    cum = F.sum("n_slots").over(upto)
    # [lo, hi) on a ring of 2**32 points; the bins that it touches make the interval join an equi join
    edge = lambda c: F.expr(f"cast({c} as decimal(20,0)) * {RING} div {max(total, 1)}").alias(c)
    src = src.select("sid", "n_slots", (cum - F.col("n_slots")).alias("lo"), cum.alias("hi")).select("sid", "n_slots", edge("lo"), edge("hi"))
    width = RING // _BINS
    spans = src.withColumn("bin", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.greatest("hi", F.col("lo") + 1) - 1) / width).cast("long"))))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id") + 1, F.lit(RING)) * F.lit(GOLDEN), F.lit(RING)).alias("u"))
    points = points.withColumn("bin", (F.col("u") / width).cast("long"))
    hits = points.join(F.broadcast(spans) if _few(spans) else spans, "bin").where("u >= lo and u < hi").select("sid", "slot", F.floor(F.col("slot") / chunk).alias("chunk"), F.floor(F.col("slot") / chunk**2).alias("chunks"))
    ranked = running(hits, ["sid"], ["chunk", "chunks"], [F.col("slot")], F.lit(1), "rank").select("sid", "slot", F.col("rank").cast("long").alias("rank"))
    ranked = ranked.join(src.select("sid", "n_slots"), "sid").where("rank < n_slots").select("sid", "rank", "slot")
    met = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("n_hit"))
    left = src.join(met, "sid", "left").where("coalesce(n_hit, 0) < n_slots").select("sid", F.explode(F.sequence(F.coalesce("n_hit", F.lit(0)), F.col("n_slots") - 1)).alias("rank"))
    return ranked.unionByName(left.withColumn("slot", F.lit(total)))


def _few(spans: DataFrame, most: int = 100_000) -> bool:
    """Proven small: at most one row per bin and per source."""
    return spans.limit(most + 1).count() <= most


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, first_slot (place in the mix of its first piece; null if not taken),
    slots (the same for each pass over its source)."""
    d = docs.select(quoted(key).alias("k"), quoted(source).alias("source"), word_count(quoted(text)).alias("size"))
    d = checkpointed(d)
    src = checkpointed(targets(d, weights, share, most)).withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long"))
    largest = src.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    digits = max(1, min(8, -(-max(1, largest // ROWS).bit_length() // 4)))

    d = d.join(F.broadcast(src) if _few(src) else src, d["source"].eqNullSafe(src["source"])).select("k", d["source"], "size", "sid", "source_size", "target", "quota")
    d = d.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit("")))))
    d = d.withColumn("chunk", F.substring("h", 1, digits)).withColumn("chunks", F.substring("h", 1, max(1, digits - 3)))
    line = running(d, ["sid"], ["chunk", "chunks"], [F.col("h"), F.col("k"), F.col("size")], F.col("size"), "start")

    taken = line.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    taken = taken.select("sid", "size", "start", "quota", "pass", (F.col("start") + F.col("pass") * F.col("source_size")).alias("a"))
    taken = taken.where("a < quota").withColumn("b", F.least(F.col("a") + F.col("size"), "quota"))
    pieces = taken.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    pieces = pieces.select("sid", "size", "start", "pass", "rank", (F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).alias("n"))
    slots = schedule(src, block)
    got = pieces.join(slots, ["sid", "rank"]).groupBy("sid", "start", "size").agg(
        F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.array(*[F.min(F.when(F.col("pass") == p, F.col("slot"))) for p in range(most)]).alias("slots")
    )
    # a row with words has a start of its own within its source, so (sid, start, size) names it
    got = got.select(F.col("sid").alias("g_sid"), F.col("start").alias("g_start"), F.col("size").alias("g_size"), "taken", "first_slot", "slots")
    out = line.join(got, (F.col("sid") == F.col("g_sid")) & (F.col("start") == F.col("g_start")) & (F.col("size") == F.col("g_size")), "left")
    return out.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "slots")


#: The same mix in DuckDB; a document's taken words are what its passes share with its source's quota, and its first slot
#: is the first, in the order of golden-ratio points, of the blocks that it has a part in.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS sid,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS words FROM g
), f AS (
  SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), t AS (
  SELECT source, sid, source_size, CASE WHEN cap / w <= lev THEN cap
    ELSE w * (min(CASE WHEN cap / w > lev THEN {{'r': cap / w, 's': sid, 'lev': lev}} END) OVER ()).lev END AS target FROM f
), q AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS quota FROM t
), b AS (
  SELECT sid, ceil(quota / {BLOCK}.0)::BIGINT AS n_slots, sum(ceil(quota / {BLOCK}.0)::BIGINT) OVER (ORDER BY sid)::HUGEINT AS upto,
    sum(ceil(quota / {BLOCK}.0)::BIGINT) OVER ()::HUGEINT AS total FROM q
), p AS (
  SELECT k AS slot, ((k + 1) % {RING}) * {GOLDEN} % {RING} AS u FROM (SELECT unnest(range(0, max(total)::BIGINT)) AS k FROM b)
), m AS (
  SELECT sid, slot, n_slots, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM p JOIN b ON u >= (upto - n_slots) * {RING} // total AND u < upto * {RING} // total
), z AS (
  SELECT b.sid, k.rank, coalesce(m.slot, total::BIGINT) AS slot FROM b, LATERAL (SELECT unnest(range(0, n_slots)) AS rank) k LEFT JOIN m ON m.sid = b.sid AND m.rank = k.rank
), l AS (
  SELECT row_number() OVER () AS id, d.*, q.sid, q.source_size, q.target, quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), v AS (
  SELECT id, sid, start + y * source_size AS a, least(start + y * source_size + size, quota) AS b FROM l, (SELECT unnest([0, 1]) AS y) WHERE size > 0 AND start + y * source_size < quota
), s AS (
  SELECT id, min(slot) AS first_slot FROM v JOIN z ON z.sid = v.sid AND z.rank BETWEEN a // {BLOCK} AND (b - 1) // {BLOCK} GROUP BY id
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (greatest(0, least(start + size, quota) - start) + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken, first_slot
FROM l LEFT JOIN s USING (id)
"""
