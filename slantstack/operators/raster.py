"""Rasters as (y, x, v) rows: block means, masks, clips, neighbours, point windows, profiles, resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantstack.functions import scalar as S
from slantstack.model import Box, Grid

#: The eight neighbours.
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def block_means(df: DataFrame, ny: int, nx: int, grid: Grid, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Means of ny x nx blocks; NULL if under half of a block has data; incomplete blocks at the far edges are dropped."""
    whole = df.where((F.col("y") < grid.length // ny * ny) & (F.col("x") < grid.width // nx * nx))
    by = [*keys, F.floor(F.col("y") / ny).cast("int").alias("y"), F.floor(F.col("x") / nx).cast("int").alias("x")]
    return whole.groupBy(*by).agg(F.when(F.count(value) >= 0.5 * ny * nx, F.avg(value)).alias(value))


def mask_box(df: DataFrame, boxes: list[Box], value: str = "v") -> DataFrame:
    """NULL inside any of a few boxes."""
    hit = F.lit(False)
    for b in boxes:
        hit = hit | S.inside(b)
    return df.withColumn(value, F.when(~hit, F.col(value)))


def with_data(packed: DataFrame, values: str) -> DataFrame:
    """Packed pixels without those whose values are all NULL."""
    return packed.where(F.exists(values, lambda v: v.isNotNull()))


def clip(df: DataFrame, box: Box) -> DataFrame:
    """Rows inside a box, counted from its corner; the filter reaches the scan."""
    return df.where(S.inside(box)).withColumn("y", F.col("y") - box.y1).withColumn("x", F.col("x") - box.x1)


def mask_with(df: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """Times a mask raster (mask: y, x, mask); NULL where it is 0, NULL or absent."""
    return df.join(mask.select("y", "x", "mask"), ["y", "x"], "left").withColumn(value, F.col(value) * F.nullif("mask", F.lit(0))).drop("mask")


def coherence_mean(obs: DataFrame, zero_as_null: bool = True) -> DataFrame:
    """y, x, coh_avg over pairs that have coherence; no coherence at all is NULL, or 0."""
    mean = F.avg(F.nullif("coh", F.lit(0.0)))
    return obs.groupBy("y", "x").agg((mean if zero_as_null else F.coalesce(mean, F.lit(0.0))).alias("coh_avg"))


def mask_coherence(obs: DataFrame, threshold: float) -> DataFrame:
    """Phases NULL where the mean coherence is at the threshold or below."""
    low = coherence_mean(obs, zero_as_null=False)
    return obs.join(low, ["y", "x"]).withColumn("ph", F.when(F.col("coh_avg") > threshold, F.col("ph"))).drop("coh_avg")


def neighbours(df: DataFrame) -> DataFrame:
    """Each row once for each of its eight neighbours' places (y, x), with its own as (ny, nx): an equi-join finds neighbours."""
    offset = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AROUND])).alias("o")
    return df.select("*", offset).withColumn("ny", F.col("y")).withColumn("nx", F.col("x")).withColumn("y", F.col("y") + F.col("o.dy")).withColumn("x", F.col("x") + F.col("o.dx")).drop("o")


def fill_holes(df: DataFrame, value: str = "v") -> DataFrame:
    """0 or NULL replaced by the mean of the neighbours that have data, 0 if none has."""
    lent = neighbours(df.select("y", "x", F.nullif(value, F.lit(0.0)).alias("n")).where("n is not null")).groupBy("y", "x").agg(F.avg("n").alias("lent"))
    return df.join(lent, ["y", "x"], "left").withColumn(value, F.coalesce(F.nullif(value, F.lit(0.0)), "lent", F.lit(0.0))).drop("lent")


def locate(points: DataFrame, grid: Grid) -> DataFrame:
    """Points (lat, lon) with their nearest pixel; NULL outside the grid."""
    y, x = S.pixel_y(F.col("lat"), grid), S.pixel_x(F.col("lon"), grid)
    ok = y.between(0, grid.length - 1) & x.between(0, grid.width - 1)
    return points.withColumn("y", F.when(ok, y)).withColumn("x", F.when(ok, x))


def values_at(points: DataFrame, df: DataFrame, grid: Grid, window: int = 3, value: str = "v") -> DataFrame:
    """pid, lat, lon, y, x, value at the pixel and mean of the odd window around it, cut at the edges. NULL outside."""
    half, at = window // 2, locate(points, grid)
    reach = F.sequence(F.lit(-half), F.lit(half))
    around = at.withColumn("dy", F.explode_outer(F.when(F.col("y").isNotNull(), reach))).withColumn("dx", F.explode_outer(F.when(F.col("y").isNotNull(), reach)))
    spread = around.select("pid", "lat", "lon", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    own = (F.col("y") == F.col("py")) & (F.col("x") == F.col("px"))
    return spread.join(df, ["y", "x"], "left").groupBy("pid", "lat", "lon", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max(F.when(own, F.col(value))).alias("value"), F.avg(value).alias("mean"))


def profile(df: DataFrame, line: tuple[int, int, int, int], grid: Grid, value: str = "v") -> DataFrame:
    """s, x, y, distance, value of int(length) samples from one pixel to another, rounded to even on ties.

    Distances are even steps from 0 to the line's length in whole metres, at the latitude of its middle.
    """
    x1, y1, x2, y2 = line
    n = max(1, int(((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5))
    north, east = grid.spacing_at(grid.corner_lat + grid.post_lat * (y1 + y2) / 2)
    metres = int(math.hypot((x2 - x1) * east, (y2 - y1) * north))
    step = F.col("s") / F.lit(max(1, n - 1))
    fx, fy = F.lit(float(x1)) + step * (x2 - x1), F.lit(float(y1)) + step * (y2 - y1)
    samples = df.sparkSession.range(n).select(F.col("id").cast("int").alias("s"), F.rint(fx).cast("int").alias("x"), F.rint(fy).cast("int").alias("y"))
    return F.broadcast(samples).join(df, ["y", "x"], "left").select("s", "x", "y", (step * metres).alias("distance"), value)


def resample_bilinear(df: DataFrame, source: Grid, target: Grid, value: str = "v") -> DataFrame:
    """Values on another grid from the four pixels around; NULL unless all four have data."""
    cells = df.sparkSession.range(target.length * target.width).select(F.floor(F.col("id") / target.width).cast("int").alias("y"), (F.col("id") % target.width).cast("int").alias("x"))
    fy, fx = (S.latitude(F.col("y"), target) - source.corner_lat) / source.post_lat, (S.longitude(F.col("x"), target) - source.corner_lon) / source.post_lon
    placed = cells.withColumn("fy", F.round(fy, 9)).withColumn("fx", F.round(fx, 9)).withColumn("y0", F.least(F.floor("fy"), F.lit(source.length - 2)).cast("int")).withColumn("x0", F.least(F.floor("fx"), F.lit(source.width - 2)).cast("int"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    wy, wx = F.col("fy") - F.col("y0"), F.col("fx") - F.col("x0")
    weight = F.when(F.col("k.a") == 1, wy).otherwise(1 - wy) * F.when(F.col("k.b") == 1, wx).otherwise(1 - wx)
    inside = F.col("fy").between(0, source.length - 1) & F.col("fx").between(0, source.width - 1)
    spread = placed.where(inside).select("y", "x", corner, "fy", "fx", "y0", "x0").select("y", "x", (F.col("y0") + F.col("k.a")).alias("sy"), (F.col("x0") + F.col("k.b")).alias("sx"), weight.alias("w"))
    src = df.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"))
    got = spread.join(src, ["sy", "sx"], "left").groupBy("y", "x").agg(F.when(F.count_if(F.col("v").isNotNull() | (F.col("w") == 0)) == 4, F.sum(F.col("w") * F.coalesce("v", F.lit(0.0)))).alias(value))
    return cells.join(got, ["y", "x"], "left")


def percentiles(df: DataFrame, low: float, high: float, value: str = "v") -> DataFrame:
    """One row of two exact percentiles (linear between ranks), for display ranges."""
    return df.agg(F.percentile(value, F.lit(low / 100)).alias("low"), F.percentile(value, F.lit(high / 100)).alias("high"))
