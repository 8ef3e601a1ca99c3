"""Pair and pixel decisions: bad pairs by coverage and coherence, the nine-criteria mask, threshold adjustment."""

from __future__ import annotations

import math
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantstack.model import Thresholds

#: Criteria below whose threshold a pixel is masked; the others mask above.
FLOORS = ("coh_avg", "n_unw", "max_run")
CRITERIA = tuple(f.name for f in fields(Thresholds))


def pair_quality(packed: DataFrame, pairs: DataFrame, n_epochs: int) -> DataFrame:
    """p, coverage, coherence of each pair within the valid area: pixels with data in as many pairs as there are epochs.

    Whether a pixel is valid shows in its own packed row, so this is one pass with one row a pair and task shuffled.
    """
    valid = packed.where(F.size(F.filter("ph", lambda v: v.isNotNull())) >= n_epochs)
    rows = valid.select(F.posexplode(F.arrays_zip("ph", "coh")).alias("p", "o"))
    per = rows.groupBy("p").agg((F.count("o.ph") / F.count(F.lit(1))).alias("coverage"), F.avg(F.nullif("o.coh", F.lit(0.0))).alias("coherence"))
    return pairs.select("p").join(F.broadcast(per), "p", "left").select("p", "coverage", "coherence")


def bad_pairs(quality: DataFrame, coverage: float = 0.3, coherence: float = 0.05) -> DataFrame:
    """p, coverage, coherence, bad: below a threshold, or without a figure."""
    good = (F.col("coverage") >= coverage) & (F.col("coherence") >= coherence)
    return quality.withColumn("bad", ~F.coalesce(good, F.lit(False)))


def require_good(decided: DataFrame) -> DataFrame:
    """An error if every pair is bad."""
    if decided.where("not bad").isEmpty():
        raise ValueError("all pairs are bad; the thresholds leave nothing to invert")
    return decided


def adjusted(stats: DataFrame, limits: Thresholds) -> tuple[Thresholds, list[str]]:
    """Thresholds that would mask every pixel give way to the best pixel's value, rounded up on the scale where less is better."""
    row = stats.agg(*[(F.max(c) if c in FLOORS else F.min(c)).alias(c) for c in CRITERIA if c in stats.columns]).first().asDict()
    changed = {}
    for c, best in row.items():
        if best is None:
            continue
        sign = -1 if c in FLOORS else 1
        if sign * best > sign * getattr(limits, c):
            changed[c] = float(sign * math.ceil(sign * best))
    return replace(limits, **changed), sorted(changed)


def mask_board(stats: DataFrame, limits: Thresholds, keep_isolated: bool = True) -> DataFrame:
    """stats with keep_<criterion> and mask (1 keeps; NULL where there is no velocity). Equality keeps; a missing figure masks.

    Pixels without neighbours have no stc: they pass, or fail with keep_isolated off.
    """
    out, whole = stats, F.lit(True)
    for c in CRITERIA:
        if c not in stats.columns:
            continue
        v = F.coalesce("stc", F.lit(0.0 if keep_isolated else limits.stc + 1)) if c == "stc" else F.col(c)
        ok = F.coalesce(v >= getattr(limits, c) if c in FLOORS else v <= getattr(limits, c), F.lit(False))
        out = out.withColumn(f"keep_{c}", ok.cast("int"))
        whole = whole & ok
    return out.withColumn("mask", F.when(F.col("vel").isNotNull(), whole.cast("int")) if "vel" in stats.columns else whole.cast("int"))


def mask_report(board: DataFrame) -> DataFrame:
    """criterion, n, masked_percent: what each criterion masks, and all together ("mask")."""
    named = [c for c in board.columns if c.startswith("keep_")] + ["mask"]
    rows = board.where("mask is not null").select(F.explode(F.array(*[F.struct(F.lit(c.removeprefix("keep_")).alias("criterion"), F.col(c).alias("k")) for c in named])).alias("s"))
    return rows.groupBy("s.criterion").agg(F.count(F.lit(1)).alias("n"), (100 * F.count_if(F.col("s.k") == 0) / F.count(F.lit(1))).alias("masked_percent"))


def apply_mask(df: DataFrame, board: DataFrame, value: str = "vel") -> DataFrame:
    return df.join(board.select("y", "x", "mask"), ["y", "x"]).withColumn(f"{value}_masked", F.when(F.col("mask") == 1, F.col(value)))
