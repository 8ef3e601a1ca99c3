"""Text forms of results: series, lists, KML, GeoJSON; and Parquet tables cut by row block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantstack.model import Grid


def series_lines(series: DataFrame, x: int, y: int, grid: Grid, reference: str, gap_days: list[str] = ()) -> DataFrame:
    """n, line: a point's series (t, day, yr, d) with its position, reference, fitted line and gaps ahead."""
    fit = series.agg(F.regr_slope("d", "yr").alias("v"), F.regr_intercept("d", "yr").alias("c"))
    head = [(-6, f"# x, y    : {x}, {y}"), (-5, f"# lat, lon: {grid.corner_lat + y * grid.post_lat:.5f}, {grid.corner_lon + x * grid.post_lon:.5f}"), (-4, f"# ref      : {reference}"), (-2, f"# gap      : {', '.join(gap_days)}"), (-1, "# date mm")]
    top = series.sparkSession.createDataFrame(head, "n int, line string")
    model = fit.select(F.lit(-3).alias("n"), F.format_string("# linear   : %.3f*t%+.3f", "v", "c").alias("line"))
    rows = series.select(F.col("t").alias("n"), F.concat_ws(" ", F.date_format("day", "yyyyMMdd"), F.when(F.col("d").isNotNull(), F.format_string("%.2f", "d")).otherwise("nan")).alias("line"))
    return top.unionByName(model).unionByName(rows.where("line is not null"))


def pair_stats_lines(quality: DataFrame, names: DataFrame) -> DataFrame:
    """line: name, baseline, days, coverage, coherence, and a mark for bad pairs."""
    mark = F.when(F.col("bad"), " *").otherwise("")
    return names.join(F.broadcast(quality), "p").select("p", F.concat(F.format_string("%s  %6.1f  %4d  %.3f  %.3f", "name", "dbperp", "dt", F.coalesce("coverage", F.lit(float("nan"))), F.coalesce("coherence", F.lit(float("nan")))), mark).alias("line"))


def write_lines(lines: DataFrame, path: str, order: str = "n") -> None:
    """A small ordered text file in one part."""
    lines.repartitionByRange(1, order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def kml_point(lat: float, lon: float) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Point><coordinates>{lon},{lat}</coordinates></Point></Placemark></kml>\n'


def kml_line(points: list[tuple[float, float]]) -> str:
    """points: lat, lon."""
    at = " ".join(f"{lon},{lat}" for lat, lon in points)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><LineString><coordinates>{at}</coordinates></LineString></Placemark></kml>\n'


def geojson_features(features: DataFrame) -> DataFrame:
    """line: a GeoJSON feature of each (level, coords)."""
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("level").alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("coords").alias("coordinates")).alias("geometry"))).alias("line"))


def write_blocks(df: DataFrame, path: str, rows: int = 256, mode: str = "overwrite") -> None:
    """Parquet partitioned by block of image rows, so that a region reads only its blocks."""
    block = df.withColumn("row_block", F.floor(F.col("y") / rows).cast("int"))
    block.repartition("row_block").write.mode(mode).partitionBy("row_block").option("compression", "zstd").parquet(path)


def read_blocks(spark, path: str, y1: int | None = None, y2: int | None = None, rows: int = 256) -> DataFrame:
    """Rows [y1, y2) through partition pruning."""
    df = spark.read.parquet(path)
    if y1 is not None:
        df = df.where((F.col("row_block") >= y1 // rows) & (F.col("y") >= y1))
    if y2 is not None:
        df = df.where((F.col("row_block") <= (y2 - 1) // rows) & (F.col("y") < y2))
    return df.drop("row_block")


def write_stack(folder: str, cum: DataFrame, meta: dict[str, str], layers: dict[str, DataFrame]) -> None:
    """A result store: the series, one-row metadata, and any layers, each a Parquet table."""
    write_blocks(cum, f"{folder}/cum")
    cum.sparkSession.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    for name, df in layers.items():
        write_blocks(df, f"{folder}/{name}")


def layer_or_none(spark, folder: str, name: str) -> DataFrame | None:
    """An optional layer of a store."""
    from pyspark.errors import AnalysisException

    try:
        return read_blocks(spark, f"{folder}/{name}")
    except AnalysisException:
        return None
