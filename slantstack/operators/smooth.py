"""Gaussian smoothing in time and space that leaves missing values out and divides by the weights that are there.

In time: weights between epochs are a small table, broadcast. In space: the kernel is separable, and so are the weighted
sum and the sum of weights, so a value goes along rows, then along columns (2r+1 copies each, not (2r+1)^2).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def temporal_weights(epochs: DataFrame, sigma: float) -> DataFrame:
    """t, t2, w: exp(-dt^2 / 2 sigma^2) where dt^2 < 8 sigma."""
    a, b = epochs.select("t", "yr"), epochs.select(F.col("t").alias("t2"), F.col("yr").alias("yr2"))
    sq = F.pow(F.col("yr") - F.col("yr2"), 2)
    return a.join(F.broadcast(b), sq < 8 * sigma).select("t", "t2", F.exp(-sq / (2 * sigma * sigma)).alias("w"))


def temporal(cum: DataFrame, epochs: DataFrame, sigma: float) -> DataFrame:
    """y, x, t, yr, d, lp, hp: low pass and what is left."""
    w = temporal_weights(epochs, sigma).withColumnRenamed("t", "t0").withColumnRenamed("t2", "t")
    spread = cum.where("d is not null").select("y", "x", "t", "d").join(F.broadcast(w), "t")
    low = spread.groupBy("y", "x", F.col("t0").alias("t")).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("lp"))
    return cum.join(low, ["y", "x", "t"], "left").withColumn("hp", F.col("d") - F.col("lp"))


def _along(df: DataFrame, axis: str, sigma: float, keys: list[str]) -> DataFrame:
    r = max(1, math.ceil(4 * sigma))
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("g")) for k in range(-r, r + 1)])).alias("o")
    spread = df.select("*", kernel).withColumn(axis, F.col(axis) + F.col("o.k"))
    return spread.groupBy(*keys, "y", "x").agg(F.sum(F.col("num") * F.col("o.g")).alias("num"), F.sum(F.col("den") * F.col("o.g")).alias("den"))


def spatial(df: DataFrame, sigma_y: float, sigma_x: float, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """keys, y, x, lp at the rows of ``df``; the kernel reaches four sigma."""
    k = list(keys)
    start = df.where(F.col(value).isNotNull()).select(*k, "y", "x", F.col(value).alias("num"), F.lit(1.0).alias("den"))
    both = _along(_along(start, "x", sigma_x, k), "y", sigma_y, k)
    return df.select(*k, "y", "x").join(both, [*k, "y", "x"], "left").select(*k, "y", "x", (F.col("num") / F.nullif("den", F.lit(0.0))).alias("lp"))


def filtered(cum: DataFrame, epochs: DataFrame, sigma_t: float, sigma_y: float, sigma_x: float) -> DataFrame:
    """y, x, t, yr, d: the series less the part that is short in time and wide in space."""
    hp = temporal(cum, epochs, sigma_t)
    noise = spatial(hp, sigma_y, sigma_x, ("t",), "hp")
    return hp.join(noise.withColumnRenamed("lp", "noise"), ["t", "y", "x"]).select("y", "x", "t", "yr", (F.col("d") - F.coalesce("noise", F.lit(0.0))).alias("d"))


def default_width(epochs: DataFrame) -> float:
    """Years: three mean intervals."""
    r = epochs.agg((F.max("yr") - F.min("yr")).alias("span"), F.count(F.lit(1)).alias("n")).first()
    return 3 * r["span"] / max(1, r["n"] - 1)
