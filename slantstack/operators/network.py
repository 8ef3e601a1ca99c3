"""Pairs, epochs and closed triangles as small tables; set algebra on pair lists; gaps and segments of a network.

Network tables have a row a pair or loop (thousands at most, whatever the image size), so joins on them broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantstack.functions import scalar as S

PAIR = r"(?:^|/)(2\d{7}_2\d{7})/?$"


def local(df: DataFrame) -> DataFrame:
    """A network table (a row an epoch, pair or loop) computed once and kept in the plan as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def constant(rows, fields: tuple[str, ...]):
    """Array of structs of integers as one constant: network metadata that goes along with every pixel row."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{f}', {int(r[f])}" for f in fields) + ")" for r in rows) + ")")


def pairs_from_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """Sorted distinct pair names from directory paths: 17 characters, both halves beginning with 2."""
    name = F.regexp_extract(F.col(col), PAIR, 1)
    return paths.select(name.alias("name")).where("name <> ''").distinct().orderBy("name")


def epochs_of(names: DataFrame) -> DataFrame:
    """t, d, yr of all dates in pair names."""
    d = names.select(F.explode(F.array(S.primary_date(F.col("name")), S.secondary_date(F.col("name")))).alias("d")).distinct()
    w = Window.orderBy("d")
    return d.select((F.row_number().over(w) - 1).alias("t"), "d", S.year_fraction(F.col("d"), F.min("d").over(w)).alias("yr"))


def index_pairs(names: DataFrame, epochs: DataFrame) -> DataFrame:
    """p, i, j, name: pairs by their epochs' numbers."""
    e = F.broadcast(epochs)
    a = names.withColumn("d1", S.primary_date(F.col("name"))).withColumn("d2", S.secondary_date(F.col("name")))
    b = a.join(e.select(F.col("t").alias("i"), F.col("d").alias("d1")), "d1").join(e.select(F.col("t").alias("j"), F.col("d").alias("d2")), "d2")
    return b.select((F.row_number().over(Window.orderBy("i", "j")) - 1).alias("p"), "i", "j", "name")


def triangles(pairs: DataFrame) -> DataFrame:
    """l, p12, p23, p13, a, b, c of pairs (p, i, j) that close: i-j, j-k and i-k."""
    a = pairs.select(F.col("p").alias("p12"), F.col("i").alias("a"), F.col("j").alias("b"))
    b = pairs.select(F.col("p").alias("p23"), F.col("i").alias("b"), F.col("j").alias("c"))
    c = pairs.select(F.col("p").alias("p13"), F.col("i").alias("a"), F.col("j").alias("c"))
    found = a.join(F.broadcast(b), "b").join(F.broadcast(c), ["a", "c"])
    return found.select((F.row_number().over(Window.orderBy("p12", "p23")) - 1).alias("l"), "p12", "p23", "p13", "a", "b", "c")


def loop_pairs(loops: DataFrame) -> DataFrame:
    """l, p: the three pairs of each loop."""
    return loops.select("l", F.explode(F.array("p12", "p23", "p13")).alias("p"))


def without_loop(pairs: DataFrame, loops: DataFrame) -> DataFrame:
    return pairs.join(F.broadcast(loop_pairs(loops).select("p").distinct()), "p", "left_anti")


def loop_counts(pairs: DataFrame, loops: DataFrame) -> DataFrame:
    n = loop_pairs(loops).groupBy("p").agg(F.count(F.lit(1)).alias("n_loop"))
    return pairs.join(F.broadcast(n), "p", "left").select("p", "i", "j", F.coalesce("n_loop", F.lit(0)).alias("n_loop"))


def increments(pairs: DataFrame) -> DataFrame:
    """p, k: the increments k..k+1 that a pair spans (the ones of its row of the design matrix)."""
    return pairs.select("p", F.explode(F.sequence("i", F.col("j") - 1)).alias("k"))


def signed_epochs(pairs: DataFrame) -> DataFrame:
    """p, t, sign: -1 at the first epoch, +1 at the second (the cumulative form of the design matrix)."""
    return pairs.select("p", F.explode(F.array(F.struct(F.col("i").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("j").alias("t"), F.lit(1).alias("sign")))).alias("s")).select("p", "s.*")


def gaps(pairs: DataFrame, epochs: DataFrame) -> DataFrame:
    """k, is_gap, n_span of every increment: a gap is spanned by no pair."""
    spans = increments(pairs).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    last = epochs.agg(F.max("t").alias("m"))
    ks = epochs.select(F.col("t").alias("k")).join(F.broadcast(last), F.col("k") < F.col("m")).select("k")
    return ks.join(F.broadcast(spans), "k", "left").select("k", F.col("n").isNull().cast("int").alias("is_gap"), F.coalesce("n", F.lit(0)).alias("n_span"))


def segments(pairs: DataFrame, epochs: DataFrame) -> DataFrame:
    """seg, first_t, last_t, n_epoch, years of the parts of the network between gaps."""
    before = gaps(pairs, epochs).select((F.col("k") + 1).alias("t"), F.col("is_gap"))
    w = Window.orderBy("t")
    marked = epochs.join(F.broadcast(before), "t", "left").withColumn("seg", F.sum(F.coalesce("is_gap", F.lit(0))).over(w))
    return marked.groupBy("seg").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_epoch"), (F.max("yr") - F.min("yr")).alias("years"))


def gap_middles(pairs: DataFrame, epochs: DataFrame, day: str = "q") -> DataFrame:
    """k, mid: the day half-way across each gap."""
    e = epochs.select("t", F.col(day).alias("d"))
    g = gaps(pairs, epochs).where("is_gap = 1")
    a, b = e.select(F.col("t").alias("k"), F.col("d").alias("d1")), e.select((F.col("t") - 1).alias("k"), F.col("d").alias("d2"))
    return g.join(F.broadcast(a), "k").join(F.broadcast(b), "k").select("k", F.date_add("d1", F.floor(F.date_diff("d2", "d1") / 2).cast("int")).alias("mid"))


def minus(a: DataFrame, b: DataFrame, key: str = "p") -> DataFrame:
    """Rows of ``a`` whose key isn't in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def merged(*lists: DataFrame, key: str = "p") -> DataFrame:
    """Distinct union of lists."""
    out = lists[0].select(key)
    for x in lists[1:]:
        out = out.unionByName(x.select(key))
    return out.distinct()


def unused_epochs(epochs: DataFrame, good: DataFrame) -> DataFrame:
    """Epochs that no good pair has."""
    used = good.select(F.explode(F.array("i", "j")).alias("t")).distinct()
    return epochs.join(F.broadcast(used), "t", "left_anti")


def baselines(pairs: DataFrame, bperp: DataFrame, epochs: DataFrame, day: str = "q") -> DataFrame:
    """p, dt (days), dbperp of each pair. bperp: t, bperp."""
    e = F.broadcast(epochs.select("t", F.col(day).alias("d")).join(F.broadcast(bperp), "t"))
    a, b = e.select(F.col("t").alias("i"), F.col("d").alias("d1"), F.col("bperp").alias("b1")), e.select(F.col("t").alias("j"), F.col("d").alias("d2"), F.col("bperp").alias("b2"))
    return pairs.join(a, "i").join(b, "j").select("p", F.date_diff("d2", "d1").alias("dt"), (F.col("b2") - F.col("b1")).alias("dbperp"))


def dummy_baselines(epochs: DataFrame, seed: int = 1) -> DataFrame:
    """t, bperp: made-up baselines, so that plots show a network. Epoch 0 has 0; of the others, by number modulo 4, 1 lies in
    0.5..1, 2 in -1..-0.5, 3 in 0..0.5 and 0 in -0.5..0, by a rule on the number and ``seed`` in place of random draws."""
    draw = F.pmod(F.col("t").cast("long") * 7919 + seed * 104729, F.lit(1000)) / 2000.0
    turn = F.col("t") % 4
    value = F.when(turn == 1, draw + 0.5).when(turn == 2, -draw - 0.5).when(turn == 3, draw).otherwise(-draw)
    return epochs.select("t", F.when(F.col("t") == 0, 0.0).otherwise(value).alias("bperp"))
