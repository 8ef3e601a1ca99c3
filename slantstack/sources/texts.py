"""Small text tables: baselines, pair lists, parameters, ranges, points, look lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantstack.model import Box, Grid, Sensor, parse_range


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """n (line number), f (blank-separated fields) of lines that have any. A file is one task: its lines are ordered."""
    lines = spark.read.option("wholetext", "true").text(path)
    split = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return split.select("n", "line", F.array_remove(F.split(F.trim("line"), r"\s+"), "").alias("f")).where(F.size("f") > 0)


def baselines(spark: SparkSession, path: str, epochs: DataFrame, day: str = "d") -> DataFrame:
    """t, bperp. Four columns: second date, baseline, and the first line's first date is 0. Nine or more: dates in columns 2
    and 3, their baselines in the last two. An epoch without a baseline is an error."""
    f = _fields(spark, path)
    at = lambda k: F.get("f", k if not isinstance(k, int) else F.lit(k))
    date = lambda v: F.try_to_date(v, "yyyyMMdd")
    n = F.size("f")
    new = f.where(n == 4)
    first = new.orderBy("n").limit(1).select(date(at(0)).alias("d"), F.lit(0.0).alias("bperp"))
    old = f.where(n >= 8)
    parts = [first, new.select(date(at(1)).alias("d"), at(2).cast("double").alias("bperp")), old.select(date(at(1)).alias("d"), at(n - 2).cast("double").alias("bperp")), old.select(date(at(2)).alias("d"), at(n - 1).cast("double").alias("bperp"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("d").agg(F.min("bperp").alias("bperp"))
    out = epochs.select("t", F.col(day).alias("d")).join(F.broadcast(every), "d", "left").select("t", "bperp")
    if not out.where("bperp is null").isEmpty():
        raise ValueError(f"{path} lacks a baseline of an epoch")
    return out


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """name: first field of each line, except of lines whose first field is #."""
    return _fields(spark, path).select(F.get("f", F.lit(0)).alias("name")).where("name <> '#'")


def parameter(spark: SparkSession, path: str, key: str) -> str | None:
    """Second field of the first line whose first field is the key (with or without a colon)."""
    row = _fields(spark, path).where(F.get("f", F.lit(0)).isin(key, f"{key}:")).orderBy("n").select(F.get("f", F.lit(1))).first()
    return row[0] if row else None


def parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """All keys; the first line of a key counts."""
    out: dict[str, str] = {}
    for row in _fields(spark, path).orderBy("n").select(F.get("f", F.lit(0)), F.get("f", F.lit(1))).collect():
        out.setdefault(row[0].rstrip(":"), row[1])
    return out


def read_grid(spark: SparkSession, path: str) -> Grid:
    p = parameters(spark, path)
    return Grid(int(p["width"]), int(p["nlines"]), float(p["corner_lat"]), float(p["corner_lon"]), float(p["post_lat"]), float(p["post_lon"]), float(p.get("ellipsoid_ra", 6378137.0)), float(p.get("ellipsoid_reciprocal_flattening", 298.2572236)))


def read_sensor(spark: SparkSession, path: str) -> Sensor:
    return Sensor(float(parameters(spark, path)["radar_frequency"]))


def ranges(spark: SparkSession, path: str, grid: Grid) -> list[Box]:
    return [parse_range(r[0], grid.width, grid.length) for r in _fields(spark, path).orderBy("n").select(F.get("f", F.lit(0))).collect() if not r[0].startswith("#")]


def points(spark: SparkSession, path: str) -> DataFrame:
    """pid (line number), lat, lon."""
    f = _fields(spark, path)
    return f.select(F.col("n").alias("pid"), F.expr("try_cast(get(f, 0) as double)").alias("lat"), F.expr("try_cast(get(f, 1) as double)").alias("lon")).where("lat is not null and lon is not null")


def look_list(spark: SparkSession, path: str) -> DataFrame:
    """n, disp, e, north: three paths a line."""
    return _fields(spark, path).select("n", F.get("f", F.lit(0)).alias("disp"), F.get("f", F.lit(1)).alias("e"), F.get("f", F.lit(2)).alias("north"))


def pair_folders(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path: folders of all files below a path, from Spark's own listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("path")).distinct()
