"""Ramps and height-correlated signal, fitted per epoch and subtracted everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series

#: Terms of each ramp.
RAMPS = {"1": ("one", "x", "y"), "bl": ("one", "x", "y", "xy"), "2": ("one", "x", "y", "xy", "xx", "yy")}


def _terms(ramp: str | None, height: tuple[float, float] | None) -> dict:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    every = {"one": F.lit(1.0), "x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}
    terms = {k: every[k] for k in RAMPS[ramp]} if ramp else {"one": F.lit(1.0)}
    if height:
        # Heights outside the range take part as 0.
        terms["hgt"] = F.when(F.col("hgt").between(*height), F.col("hgt")).otherwise(0.0)
    return terms


def coefficients(cum: DataFrame, ramp: str | None = "1", height: tuple[float, float] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """t, n, b_<term>: the fit of each epoch over unmasked pixels. Sums by epoch, a k x k elimination a row."""
    rows = cum.join(mask.where("mask <> 0").select("y", "x"), ["y", "x"], "left_semi") if mask is not None else cum
    return series.fit(rows, _terms(ramp, height), "d", ["t"])


def detrended(cum: DataFrame, fitted: DataFrame, ramp: str | None = "1", height: tuple[float, float] | None = None) -> DataFrame:
    """y, x, t, yr, d, trend: the fit subtracted at all pixels, masked or not, with their true heights."""
    terms = _terms(ramp, height)
    if height:
        terms["hgt"] = F.col("hgt")
    trend = F.lit(0.0)
    for name, term in terms.items():
        trend = trend + F.col(f"b_{name}") * term
    return cum.join(F.broadcast(fitted), "t").withColumn("trend", trend).select("y", "x", "t", "yr", (F.col("d") - F.col("trend")).alias("d"), "trend")


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """t, std_before, std_after, rate: what the correction takes off the population deviation, in percent."""
    a = before.groupBy("t").agg(F.stddev_pop("d").alias("std_before"))
    b = after.groupBy("t").agg(F.stddev_pop("d").alias("std_after"))
    return a.join(b, "t").select("t", "std_before", "std_after", ((F.col("std_before") - F.col("std_after")) / F.nullif("std_before", F.lit(0.0)) * 100).alias("rate"))
