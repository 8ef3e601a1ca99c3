"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at
``cap`` times its source's size, and the excess is shared again by weight until none is above.

Schedule: the points frac(t * golden ratio), t = 0, 1, ..., fall into intervals as wide as the sources' shares of
``block``-word slots, so after any number of slots every source is within a few slots of its share. A slot's rank among
its source's slots is the number of the block it takes. Ranks beyond a source's quota are void, and a source that the
points leave short by a few gets its last slots at the end, so a source's words meet its rounded target.

Blocks: a source's documents, in an order shuffled by hash, are one stream of words, repeated as often as the target
needs; block r is words [r * block, (r + 1) * block) of it. Documents are joined to slots by (source, block), and a
document's words in taken blocks are summed.

Nothing is ranked in one task: documents are numbered in about sqrt(n) hash buckets and slots in runs of about sqrt(n),
and only the totals of these are summed along a source. The driver holds one row a source, at most ``MAX_SOURCES``.

Defined results. Null text: size 0, nothing taken. Null source: a source, the last. Sources without words: target 0.
Null ids and repeated rows: a result each. Empty table: empty result. Other columns are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, spare

MAX_SOURCES = 100_000
#: 2^64 / golden ratio: t * GOLDEN modulo 2^64 are the points as 64-bit fractions.
GOLDEN = 0x9E3779B97F4A7C15


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \x09-\x0D]+"), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], cap: int = 3) -> list[tuple[str | None, int, Fraction]]:
    """(source, size, target) in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weights, total = [i % 3 + 1 for i in range(len(order))], sum(n for _, n in order)
    # A source is above its cap at any level over cap * size / weight, so they fill up in this order.
    left, weight, out = Fraction(total), sum(weights), [Fraction(0)] * len(order)
    for i in sorted(range(len(order)), key=lambda i: (Fraction(cap * order[i][1], weights[i]), i)):
        out[i] = min(Fraction(cap * order[i][1]), left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return [(s, n, t) for (s, n), t in zip(order, out, strict=True)]


def _points(edges: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.asarray(b.column(0))
            with np.errstate(over="ignore"):
                point = slot.astype(np.uint64) * np.uint64(GOLDEN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(edges, point, side="right").astype(np.int32))], names=["slot", "s"])

    return place


def schedule(spark, quotas: list[int]) -> DataFrame:
    """slot, s (number of the source) and rank of every valid slot; ``quotas``: slots of each source."""
    total, done, edges = sum(quotas), 0, []
    for q in quotas:
        done += q
        edges.append((done << 64) // max(total, 1))
    parts = max(spark.sparkContext.defaultParallelism, total >> 20)
    slots = spark.range(0, total, 1, parts).mapInArrow(_points(np.array([min(e, 2**64 - 1) for e in edges[:-1]], np.uint64)), "slot long, s int")
    run = max(1, isqrt(total))
    slots = slots.withColumn("run", F.floor(F.col("slot") / run))
    totals = slots.groupBy("s", "run").agg(F.count(F.lit(1)).alias("n"))
    before = durable(totals.select("s", "run", "n", (F.sum("n").over(Window.partitionBy("s").orderBy("run")) - F.col("n")).alias("before")), "slots")
    placed = {r["s"]: r["n"] for r in before.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("s", "run").orderBy("slot"))).join(before, ["s", "run"])
    quota = spark.createDataFrame(list(enumerate(quotas)), "s int, quota long")
    valid = ranked.select("slot", "s", (F.col("before") + F.col("rank") - 1).alias("rank")).join(F.broadcast(quota), "s").where("rank < quota").select("slot", "s", "rank")
    short = [(s, placed.get(s, 0), q) for s, q in enumerate(quotas) if placed.get(s, 0) < q]
    late = spark.createDataFrame(short, "s int, a long, q long").select((F.lit(total) + F.col("s")).alias("slot"), "s", F.explode(F.sequence("a", F.col("q") - 1)).alias("rank"))
    return valid.unionAll(late)


def taken(docs: DataFrame, *, block: int = 64, cap: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_hash, size, source_size, target and taken of every row."""
    spark = docs.sparkSession
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(seed, id_col, text_col).alias("h")), "sizes")
    groups = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(groups) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give a coarser source column")
    plan = targets([(g["source"], g["size"]) for g in groups], cap)
    words = [round(t) for _, _, t in plan]
    quotas = [-(-q // block) for q in words]
    buckets = max(1, isqrt(sum(g["n"] for g in groups)))
    sources = spark.createDataFrame([(i, s, n, float(t), q) for i, ((s, n, t), q) in enumerate(zip(plan, words, strict=True))], "s int, name string, source_size long, target double, quota long")
    known = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    totals = known.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("before"))
    local = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    streamed = known.withColumn("row", F.count(F.lit(1)).over(local)).withColumn("end", F.sum("size").over(local)).join(before, ["s", "bucket"])
    begin = F.col("before") + F.col("end") - F.col("size") + F.col("pass") * F.col("source_size")
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.nullif("source_size", F.lit(0))).cast("int") - 1))
    pieces = streamed.withColumn("pass", F.explode(F.coalesce(passes, F.array(F.lit(0))))).withColumn("begin", begin).withColumn("stop", F.least(begin + F.col("size"), F.col("quota")))
    blocks = F.when(F.col("stop") > F.col("begin"), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block)))
    pieces = pieces.select("s", "bucket", "row", "doc_id", "h", "size", "source_size", "target", "begin", "stop", F.explode_outer(blocks).alias("rank"))
    inside = F.least("stop", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    slots = schedule(spark, quotas).select("s", "rank", F.lit(1).alias("slot_taken"))
    met = pieces.join(slots, ["s", "rank"], "left").withColumn("words", F.when(F.col("slot_taken") == 1, inside).otherwise(0))
    summed = met.groupBy("s", "bucket", "row", "doc_id", "h", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    return summed.select("doc_id", F.col("h").alias("row_hash"), "size", "source_size", "target", "taken")


def row_hash(seed: int, id_col: str, text_col: str):
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with ``taken``; rows equal in id and text are one row with all their words."""
    many, key, words = spare(docs, "n_equal"), spare(docs, "row_hash"), spare(docs, "taken")
    counts = taken(docs, seed=seed, id_col=id_col, text_col=text_col, **kw).groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias(many), F.sum("taken").alias("sum_taken"))
    counts = durable(counts.where("sum_taken > 0").select(F.col("doc_id").alias("mix_id"), F.col("row_hash").alias("mix_hash"), many, F.col("sum_taken").alias(words)), "taken")
    rows = docs.withColumn(key, row_hash(seed, id_col, text_col)).alias("d").join(counts.alias("m"), F.col(f"d.{id_col}").eqNullSafe(F.col("mix_id")) & (F.col(f"d.{key}") == F.col("mix_hash")))
    columns = [*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"m.`{words}`")]
    return rows.where(F.col(many) == 1).select(columns).unionAll(rows.where(F.col(many) > 1).select(columns).dropDuplicates([id_col, text_col]))
