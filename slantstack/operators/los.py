"""Line-of-sight displacements of several looks to east-west and vertical components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_area(extents: DataFrame) -> DataFrame:
    """One row: the area that looks from both sides share, and the coarsest pixel sizes.

    extents: geom, e, lat1 (north), lat2, lon1 (west), lon2, dlat, dlon. Within a side the areas join, between sides they meet.
    """
    side = F.when(F.col("e") > 0, "a").otherwise("b")
    by = extents.groupBy(side.alias("side")).agg(F.max("lat1").alias("n"), F.min("lat2").alias("s"), F.min("lon1").alias("w"), F.max("lon2").alias("east"), F.max("dlat").alias("dlat"), F.max("dlon").alias("dlon"))
    return by.agg(F.min("n").alias("north"), F.max("s").alias("south"), F.max("w").alias("west"), F.min("east").alias("east"), F.max("dlat").alias("dlat"), F.max("dlon").alias("dlon"), F.count(F.lit(1)).alias("n_sides"))


def decompose(looks: DataFrame) -> DataFrame:
    """y, x, n_plus, n_minus, n, ew, ud from looks (geom, y, x, e, n, u, disp); NULL where a side is missing or the looks are parallel."""
    v = looks.where("disp is not null and u is not null")
    e, u, d = F.col("e"), F.col("u"), F.col("disp")
    s = v.groupBy("y", "x").agg(F.count_if(e > 0).alias("n_plus"), F.count_if(e < 0).alias("n_minus"), F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("ee"), F.sum(e * u).alias("eu"), F.sum(u * u).alias("uu"), F.sum(e * d).alias("ed"), F.sum(u * d).alias("ud0"))
    det = F.col("ee") * F.col("uu") - F.col("eu") * F.col("eu")
    ok = (F.col("n_plus") > 0) & (F.col("n_minus") > 0) & (F.abs(det) > 1e-12)
    det = F.when(ok, det)
    solved = s.select("y", "x", "n_plus", "n_minus", "n", ((F.col("uu") * F.col("ed") - F.col("eu") * F.col("ud0")) / det).alias("ew"), ((F.col("ee") * F.col("ud0") - F.col("eu") * F.col("ed")) / det).alias("ud"))
    return looks.select("y", "x").distinct().join(solved, ["y", "x"], "left").select("y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_plus", "n_minus", "n")], "ew", "ud")


def require_sides(looks: DataFrame) -> DataFrame:
    """An error if all looks are from one side."""
    r = looks.agg(F.count_if(F.col("e") > 0).alias("a"), F.count_if(F.col("e") < 0).alias("b")).first()
    if not r["a"] or not r["b"]:
        raise ValueError("looks from both sides are needed")
    return looks


def residuals(looks: DataFrame, solved: DataFrame) -> DataFrame:
    """geom, y, x, resid of each look where three or more were used."""
    return looks.join(solved.where("n >= 3").select("y", "x", "ew", "ud"), ["y", "x"]).select("geom", "y", "x", (F.col("disp") - F.col("e") * F.col("ew") - F.col("u") * F.col("ud")).alias("resid"))
