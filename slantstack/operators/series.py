"""Displacement series (y, x, t, yr, d): velocities, models, uncertainty, neighbour consistency, references, windows.

Fits are closed forms of sums, so they are partial aggregations with one shuffle of a row a pixel and task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantstack.functions import scalar as S
from slantstack.model import Box

from . import raster


def velocity(cum: DataFrame) -> DataFrame:
    """y, x, n, vel, vintercept: least-squares line, NULLs left out."""
    return cum.groupBy("y", "x").agg(F.count("d").alias("n"), F.regr_slope("d", "yr").alias("vel"), F.regr_intercept("d", "yr").alias("vintercept"))


def area_series(cum: DataFrame, box: Box, mask: DataFrame | None = None) -> DataFrame:
    """t, ref: mean over a box (and mask) by epoch."""
    inside = cum.where(S.inside(box))
    if mask is not None:
        inside = inside.join(mask.where("mask <> 0").select("y", "x"), ["y", "x"], "left_semi")
    return inside.groupBy("t").agg(F.avg("d").alias("ref"))


def rereference(cum: DataFrame, ref: DataFrame) -> DataFrame:
    """Less a reference by epoch (a row an epoch: broadcast)."""
    return cum.join(F.broadcast(ref), "t").withColumn("d", F.col("d") - F.col("ref")).drop("ref")


def from_epoch(cum: DataFrame, m: int) -> DataFrame:
    """Less the pixel's value at epoch m."""
    return cum.withColumn("d", F.col("d") - F.max(F.when(F.col("t") == m, F.col("d"))).over(Window.partitionBy("y", "x")))


def zero_first(cum: DataFrame) -> DataFrame:
    """Less the pixel's first value that isn't NULL."""
    w = Window.partitionBy("y", "x").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cum.withColumn("d", F.col("d") - F.first("d", ignorenulls=True).over(w))


def increments(cum: DataFrame) -> DataFrame:
    """y, x, t, inc: difference to the epoch before."""
    return cum.withColumn("inc", F.col("d") - F.lag("d").over(Window.partitionBy("y", "x").orderBy("t"))).where("t > 0").select("y", "x", "t", "inc")


def snap_window(epochs: DataFrame, start: str, end: str, day: str = "q") -> DataFrame:
    """One row: the first epoch at or after ``start`` and the last at or before ``end``."""
    d = F.col(day)
    return epochs.agg(F.min(F.when(d >= F.lit(start).cast("date"), F.col("t"))).alias("t1"), F.max(F.when(d <= F.lit(end).cast("date"), F.col("t"))).alias("t2"))


def nearest_epoch(epochs: DataFrame, when: str, day: str = "q") -> DataFrame:
    """The epoch nearest to a day, the earlier on ties."""
    away = F.abs(F.date_diff(day, F.lit(when).cast("date")))
    return epochs.agg(F.min_by("t", F.struct(away, "t")).alias("t"))


def _sums(terms: dict[str, object], y: str) -> list:
    names = list(terms)
    ok = lambda e: F.when(F.col(y).isNotNull(), e)
    out = [F.sum(ok(terms[a] * terms[b])).alias(f"s_{a}{b}") for k, a in enumerate(names) for b in names[k:]]
    return out + [F.sum(terms[a] * F.col(y)).alias(f"r_{a}") for a in names]


def _eliminate(df: DataFrame, names: list[str]) -> DataFrame:
    """Gauss steps as columns, so that no expression is repeated inside another."""
    n = len(names)
    cell = lambda r, c: f"s_{names[min(r, c)]}{names[max(r, c)]}" if c < n else f"r_{names[r]}"
    df = df.withColumns({f"g{r}_{c}": F.col(cell(r, c)) for r in range(n) for c in range(n + 1)})
    for k in range(n):
        pivot = F.when(F.abs(F.col(f"g{k}_{k}")) > 1e-9, F.col(f"g{k}_{k}"))
        df = df.withColumns({f"g{k}_{c}": F.col(f"g{k}_{c}") / pivot for c in range(k + 1, n + 1)})
        df = df.withColumns({f"g{r}_{c}": F.col(f"g{r}_{c}") - F.col(f"g{r}_{k}") * F.col(f"g{k}_{c}") for r in range(k + 1, n) for c in range(k + 1, n + 1)})
    for k in reversed(range(n)):
        value = F.col(f"g{k}_{n}")
        for c in range(k + 1, n):
            value = value - F.col(f"g{k}_{c}") * F.col(f"b_{names[c]}")
        df = df.withColumn(f"b_{names[k]}", value)
    return df


def fit(df: DataFrame, terms: dict[str, object], value: str, keys: list[str]) -> DataFrame:
    """keys, n, b_<term>: least squares of ``value`` on the terms by group; NULL where they are dependent."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), *_sums(terms, value)) if keys else df.agg(F.count(value).alias("n"), *_sums(terms, value))
    return _eliminate(sums, list(terms)).select(*keys, "n", *[f"b_{a}" for a in terms])


def _yearly():
    a = 2 * math.pi * F.col("yr")
    return {"sin": F.sin(a), "cos": F.cos(a)}


def annual(cum: DataFrame, first_day_of_year: int = 0) -> DataFrame:
    """y, x, vel, vintercept, amplitude, peak_day: line and yearly wave. peak_day: day of the year of the rising zero, in [0, 365.25]."""
    f = fit(cum, {"one": F.lit(1.0), "lin": F.col("yr"), **_yearly()}, "d", ["y", "x"])
    day = F.atan2(-F.col("b_cos"), F.col("b_sin")) / (2 * math.pi) * 365.25 + first_day_of_year
    day = F.when(day < 0, day + 365.25).when(day > 365.25, day - 365.25).otherwise(day)
    return f.select("y", "x", F.col("b_lin").alias("vel"), F.col("b_one").alias("vintercept"), F.sqrt(F.col("b_sin") ** 2 + F.col("b_cos") ** 2).alias("amplitude"), day.alias("peak_day"))


MODELS = ("linear", "annual", "quadratic", "annual_quadratic")


def point_model(cum: DataFrame, model: str, step_days: int = 10) -> DataFrame:
    """y, x, day (since the first epoch), fitted: a model at every ``step_days`` of the series' time."""
    terms = {"one": F.lit(1.0), "lin": F.col("yr")}
    if "quadratic" in model:
        terms["quad"] = F.col("yr") * F.col("yr")
    if "annual" in model:
        terms |= _yearly()
    f = fit(cum, terms, "d", ["y", "x"])
    ends = cum.groupBy("y", "x").agg(F.max("yr").alias("last"))
    days = f.join(ends, ["y", "x"]).withColumn("day", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") * 365.25).cast("int"), F.lit(step_days)))).withColumn("yr", F.col("day") / 365.25)
    fitted = F.lit(0.0)
    for name, term in terms.items():
        fitted = fitted + F.col(f"b_{name}") * term
    return days.select("y", "x", "day", fitted.alias("fitted"))


def draw(n_epochs: int, replicates: int):
    """b, t, times: how often replicate b draws epoch t; an integer rule in place of a random generator, so any engine agrees."""
    return [(b, (b * 7919 + k * 104729 + (b * k * k) % 7907) % n_epochs) for b in range(replicates) for k in range(n_epochs)]


def velocity_std(cum: DataFrame, n_epochs: int, replicates: int = 100) -> DataFrame:
    """y, x, vstd: population standard deviation of the slope over resampled epochs; replicates without a slope are left out."""
    spark = cum.sparkSession
    draws = spark.createDataFrame(draw(n_epochs, replicates), "b int, t int").groupBy("b", "t").agg(F.count(F.lit(1)).alias("w"))
    w, t, d = F.col("w"), F.col("yr"), F.col("d")
    sums = cum.where("d is not null").join(F.broadcast(draws), "t").groupBy("y", "x", "b").agg(F.sum(w).alias("n"), F.sum(w * t).alias("st"), F.sum(w * d).alias("sd"), F.sum(w * t * t).alias("stt"), F.sum(w * t * d).alias("std"))
    det = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when(det > 1e-9, (F.col("n") * F.col("std") - F.col("st") * F.col("sd")) / F.when(det > 1e-9, det))
    return sums.groupBy("y", "x").agg(F.stddev_pop(slope).alias("vstd"))


def consistency(packed: DataFrame) -> DataFrame:
    """y, x, stc: least RMS, over the neighbours, of the difference of the two series' increments; exact 0 doesn't count.

    packed: y, x, d (array). A row goes to its eight neighbours and meets them by an equi-join.
    """
    diff = F.zip_with(F.slice("d", F.lit(2), F.greatest(F.lit(0), F.size("d") - 1)), F.slice("d", F.lit(1), F.greatest(F.lit(0), F.size("d") - 1)), lambda b, a: b - a)
    steps = packed.select("y", "x", diff.alias("s"))
    lent = raster.neighbours(steps).select("y", "x", F.col("s").alias("o"))
    gap = F.filter(F.zip_with("s", "o", lambda a, b: (a - b) * (a - b)), lambda v: v.isNotNull())
    both = steps.join(lent, ["y", "x"]).select("y", "x", gap.alias("g"))
    rms = F.sqrt(F.try_divide(F.aggregate("g", F.lit(0.0), lambda a, v: a + v), F.size("g")))
    best = both.groupBy("y", "x").agg(F.min(F.nullif(rms, F.lit(0.0))).alias("stc"))
    return packed.select("y", "x").join(best, ["y", "x"], "left")


def pack_series(cum: DataFrame, n_epochs: int) -> DataFrame:
    m = F.map_from_entries(F.collect_list(F.struct("t", "d")))
    return cum.groupBy("y", "x").agg(m.alias("m")).select("y", "x", F.transform(F.sequence(F.lit(0), F.lit(n_epochs - 1)), lambda t: F.try_element_at("m", t)).alias("d"))


def spatial_rms(cum: DataFrame, n_epochs: int) -> DataFrame:
    """y, x, rms of the series against each epoch's median over pixels; NULL where an epoch is missing."""
    med = cum.groupBy("t").agg(F.median("d").alias("med"))
    dev = cum.join(F.broadcast(med), "t").withColumn("e", F.pow(F.col("d") - F.col("med"), 2))
    return dev.groupBy("y", "x").agg(F.when(F.count("e") == n_epochs, F.sqrt(F.sum("e") / n_epochs)).alias("rms"))


def stable_pixel(rms: DataFrame, gap_count: DataFrame) -> DataFrame:
    """y, x of the least rms among pixels with the fewest gaps, the first in row order on ties."""
    both = rms.join(gap_count, ["y", "x"]).where("rms is not null")
    few = both.join(F.broadcast(gap_count.agg(F.min("n_gap").alias("n_gap"))), "n_gap")
    return few.agg(F.min(F.struct("rms", "y", "x")).alias("k")).select("k.y", "k.x").where("y is not null")


def at_pixel(cum: DataFrame, pixel: DataFrame) -> DataFrame:
    """t, ref: the series of one pixel (one row, broadcast)."""
    return cum.join(F.broadcast(pixel), ["y", "x"], "left_semi").select("t", F.col("d").alias("ref"))
