"""Loop closure: residual phase around triangles of pairs, bad pairs, the reference pixel, per-pixel loop errors.

Phases are packed, one row a pixel with an array by pair number, so a loop's three phases are array look-ups: no join and
no shuffle before the aggregation. Loops are a few rows a pair and go along as an array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantstack.model import Box
from slantstack.functions import scalar as S

from . import network

TAU = 2 * math.pi


def pack(obs: DataFrame, n_pairs: int) -> DataFrame:
    """y, x, ph, coh: arrays by pair number, NULL where a pair has no row or no data."""
    grouped = obs.groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("ph", "coh")))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n_pairs - 1)), lambda p: F.try_element_at("m", p))
    return grouped.select("y", "x", at.alias("o")).select("y", "x", F.transform("o", lambda o: o["ph"]).alias("ph"), F.transform("o", lambda o: o["coh"]).alias("coh"))


def loop_phase(packed: DataFrame, loops: DataFrame) -> DataFrame:
    """y, x, l, phi: ph12 + ph23 - ph13, only where all three have data."""
    rows = loops.select("l", "p12", "p23", "p13").collect()  # network metadata
    if not rows:
        return packed.select("y", "x", F.lit(0).alias("l"), F.lit(0.0).alias("phi")).limit(0)
    tri = F.explode(network.constant(rows, ("l", "p12", "p23", "p13"))).alias("k")
    phi = F.get("ph", F.col("k.p12")) + F.get("ph", F.col("k.p23")) - F.get("ph", F.col("k.p13"))
    return packed.select("y", "x", "ph", tri).select("y", "x", F.col("k.l").alias("l"), phi.alias("phi")).where("phi is not null")


def without_cycles(phases: DataFrame, multi_prime: bool = False) -> DataFrame:
    """Loop phases less each loop's whole cycles (by its exact median) and, with multi_prime, less what is left of its median."""
    med = phases.groupBy("l").agg(F.median("phi").alias("med"))
    cycles = F.rint(F.col("med") / TAU) * TAU
    shift = F.col("med") if multi_prime else cycles
    return phases.join(F.broadcast(med), "l").select("y", "x", "l", (F.col("phi") - shift).alias("phi"))


def loop_rms(phases: DataFrame, loops: DataFrame) -> DataFrame:
    """l, n, rms of every loop; a loop without any pixel has infinite rms."""
    got = phases.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("phi") * F.col("phi"))).alias("rms"))
    return loops.join(F.broadcast(got), "l", "left").select("l", "p12", "p23", "p13", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rms", F.lit(float("inf"))).alias("rms"))


def bad_pairs(rated: DataFrame, threshold: float = 1.5) -> DataFrame:
    """p: pairs of bad loops (rms at the threshold or more) that are in no good loop."""
    good = network.loop_pairs(rated.where(F.col("rms") < threshold)).select("p")
    return network.loop_pairs(rated.where(F.col("rms") >= threshold)).select("p").distinct().join(F.broadcast(good.distinct()), "p", "left_anti")


def pixel_stats(phases: DataFrame) -> DataFrame:
    """y, x, n_loop, n_bad (phi^2 above pi^2), rms per pixel."""
    sq = F.col("phi") * F.col("phi")
    return phases.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n_loop"), F.count_if(sq > math.pi**2).alias("n_bad"), F.sqrt(F.avg(sq)).alias("rms"))


def unwrap_counts(obs: DataFrame) -> DataFrame:
    """y, x, n_unw: pairs with data."""
    return obs.groupBy("y", "x").agg(F.count("ph").alias("n_unw"))


def reference_pixel(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """y, x of the reference: among pixels with the most data and, of these, the fewest bad loops, the least rms above 0.

    Scalar aggregates, then one ordered minimum: nothing is sorted.
    """
    both = stats.join(counts, ["y", "x"]).where("rms > 0")
    full = both.join(F.broadcast(counts.agg(F.max("n_unw").alias("n_unw"))), "n_unw")
    few = full.join(F.broadcast(full.agg(F.min("n_bad").alias("n_bad"))), "n_bad")
    return few.agg(F.min(F.struct("rms", "y", "x")).alias("k")).select("k.y", "k.x").where("y is not null")


def reference_phase(obs: DataFrame, box: Box) -> DataFrame:
    """p, ref: mean phase in the reference box, NULL if it has no data."""
    return obs.groupBy("p").agg(F.avg(F.when(S.inside(box), F.col("ph"))).alias("ref"))


def referenced(obs: DataFrame, ref: DataFrame) -> DataFrame:
    return obs.join(F.broadcast(ref), "p").withColumn("ph", F.col("ph") - F.col("ref")).drop("ref")


def pairs_without_reference(ref: DataFrame) -> DataFrame:
    return ref.where("ref is null").select("p")


def referenced_loop_rms(phases: DataFrame, ref: DataFrame, loops: DataFrame) -> DataFrame:
    """l, rms of loop phases less the loop's reference phase; NULL where the reference or all pixels are missing."""
    r = ref.select("p", "ref")
    named = lambda c: F.broadcast(r.select(F.col("p").alias(c), F.col("ref").alias("r" + c)))
    base = loops.join(named("p12"), "p12").join(named("p23"), "p23").join(named("p13"), "p13").select("l", (F.col("rp12") + F.col("rp23") - F.col("rp13")).alias("base"))
    rms = phases.join(F.broadcast(base), "l").groupBy("l").agg(F.sqrt(F.avg(F.pow(F.col("phi") - F.col("base"), 2))).alias("rms"))
    return loops.join(F.broadcast(rms), "l", "left").select("l", "p12", "p23", "p13", "rms")


def loop_errors(phases: DataFrame, ref: DataFrame, loops: DataFrame) -> DataFrame:
    """y, x, n_loop_err: loops whose referenced phase exceeds pi."""
    r = ref.select("p", "ref")
    named = lambda c: F.broadcast(r.select(F.col("p").alias(c), F.col("ref").alias("r" + c)))
    base = loops.join(named("p12"), "p12").join(named("p23"), "p23").join(named("p13"), "p13").select("l", (F.col("rp12") + F.col("rp23") - F.col("rp13")).alias("base"))
    return phases.join(F.broadcast(base), "l").groupBy("y", "x").agg(F.count_if(F.abs(F.col("phi") - F.col("base")) > math.pi).alias("n_loop_err"))


def loop_flags(loops: DataFrame, bad1: DataFrame, removed: DataFrame, noref: DataFrame, bad3: DataFrame, candidates: DataFrame) -> DataFrame:
    """l, flag of every loop, by the first of these that holds one of its pairs.

    "*": bad in pass 1; "+": on the list of manual removal; "**": without a value at the reference; "***": bad in pass 3;
    "/": a candidate that remains; "": none of them.
    """
    marks = ((bad1, "*"), (removed, "+"), (noref, "**"), (bad3, "***"), (candidates, "/"))
    ranked = None
    for k, (pairs, _) in enumerate(marks):
        one = pairs.select("p", F.lit(k).alias("k"))
        ranked = one if ranked is None else ranked.unionByName(one)
    first = network.loop_pairs(loops).join(F.broadcast(ranked.groupBy("p").agg(F.min("k").alias("k"))), "p").groupBy("l").agg(F.min("k").alias("k"))
    names = F.array(*[F.lit(m) for _, m in marks])
    return loops.select("l").join(F.broadcast(first), "l", "left").select("l", F.coalesce(F.get(names, F.col("k")), F.lit("")).alias("flag"))


def remaining_candidates(rated: DataFrame, bad: DataFrame, threshold: float = 1.5) -> DataFrame:
    """p: pairs of loops that are still bad, without those that are on the list of bad ones."""
    return network.minus(network.loop_pairs(rated.where(F.col("rms") >= threshold)).select("p").distinct(), bad)


def no_loop_counts(packed: DataFrame, loops: DataFrame) -> DataFrame:
    """y, x, n_noloop: pairs with data that are in no loop with all three."""
    rows = loops.select("p12", "p23", "p13").collect()
    tri = F.expr("array(" + ", ".join(f"array({r[0]}, {r[1]}, {r[2]})" for r in rows) + ")" if rows else "cast(array() as array<array<int>>)")
    whole = F.filter(tri, lambda k: F.forall(k, lambda p: F.get("ph", p).isNotNull()))
    return packed.select("y", "x", (F.size(F.filter("ph", lambda v: v.isNotNull())) - F.size(F.array_distinct(F.flatten(whole)))).alias("n_noloop"))


def gap_flags(packed: DataFrame, pairs: DataFrame, n_epochs: int) -> DataFrame:
    """y, x, gap: for each increment 1 where no pair with data spans it."""
    rows = pairs.orderBy("p").select("i", "j").collect()
    spans = network.constant(rows, ("i", "j"))
    zero = F.array_repeat(F.lit(1), n_epochs - 1)

    def bridge(flags, s):
        # One fold over the pairs, so the packed column is evaluated once.
        return F.when(s.isNull(), flags).otherwise(F.transform(flags, lambda g, k: F.when((s["i"] <= k) & (k < s["j"]), F.lit(0)).otherwise(g)))

    used = F.zip_with("ph", spans, lambda v, s: F.when(v.isNotNull(), s))
    return packed.select("y", "x", F.aggregate(used, zero, bridge).alias("gap"))


def gap_counts(gap: DataFrame) -> DataFrame:
    return gap.select("y", "x", F.aggregate("gap", F.lit(0), lambda a, g: a + g).alias("n_gap"))


def longest_run(gap: DataFrame, years: list[float]) -> DataFrame:
    """y, x, max_run: longest time in years without a gap. years: of the epochs."""
    steps = F.array(*[F.lit(b - a) for a, b in zip(years, years[1:], strict=False)])
    zero = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("most"))

    def step(acc, s):
        now = F.when(s["g"] == 1, F.lit(0.0)).otherwise(acc["now"] + s["d"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    zipped = F.zip_with("gap", steps, lambda g, d: F.struct(g.alias("g"), d.alias("d")))
    return gap.select("y", "x", F.aggregate(zipped, zero, step, lambda a: a["most"]).alias("max_run"))
