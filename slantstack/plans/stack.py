"""A displacement stack over the star-schema tables: every view is a formula that Spark and DuckDB share.

Only this module knows ``lineitem``; operators take the canonical tables of ``slantstack.model``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slantstack.model import Grid
from slantstack.operators import network, series

#: mm per radian of the synthetic sensor.
COEF = -4.4138
#: Largest distance of a pair's epochs.
REACH = 3
SIDE = 10


@dataclass(frozen=True)
class Stack:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def grid(self) -> Grid:
        return Grid(SIDE, SIDE)

    @cached_property
    def cells(self) -> DataFrame:
        """y, x, q, n (quantity sum), k (count): the stack's raw means; one scan of three columns."""
        return self.table("lineitem").select((F.col("l_suppkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q"), F.col("l_quantity").cast("long").alias("n")).groupBy("y", "x", "q").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))

    @cached_property
    def epoch_rows(self) -> list:
        """t, q, yr: a row an acquisition, read once."""
        w = Window.orderBy("q")
        q = self.table("lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q")).distinct()
        return q.select((F.row_number().over(w) - 1).alias("t"), "q", (F.date_diff("q", F.min("q").over(w)) / F.lit(365.25)).alias("yr")).orderBy("t").collect()

    @property
    def years(self) -> list[float]:
        return [r["yr"] for r in self.epoch_rows]

    @cached_property
    def epochs(self) -> DataFrame:
        return self.spark.createDataFrame(pa.table({c: [r[c] for r in self.epoch_rows] for c in ("t", "q", "yr")}), "t int, q date, yr double")

    @cached_property
    def cum(self) -> DataFrame:
        """y, x, t, yr, d: displacement against the first epoch; pixels without it have no rows."""
        c = self.cells.join(F.broadcast(self.epochs), "q").withColumn("c", F.col("n") / F.col("k") + 2 * (F.col("x") - F.col("y")) * F.col("yr"))
        w = Window.partitionBy("y", "x")
        first = F.max(F.when(F.col("t") == 0, F.col("c"))).over(w)
        return c.withColumn("c0", first).where("c0 is not null").select("y", "x", "t", "yr", (F.col("c") - F.col("c0")).alias("d"))

    @cached_property
    def pair_rows(self) -> list[dict]:
        """p, i, j: epochs at most ``REACH`` apart, numbered in order."""
        n = len(self.epoch_rows)
        return [{"p": p, "i": i, "j": j} for p, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, min(n, i + REACH + 1)))]

    @cached_property
    def pairs(self) -> DataFrame:
        return self.spark.createDataFrame(pa.table({c: [r[c] for r in self.pair_rows] for c in ("p", "i", "j")}), "p int, i int, j int")

    @cached_property
    def pair_names(self) -> DataFrame:
        """p, i, j, d1, d2, name (yyyymmdd_yyyymmdd)."""
        e = F.broadcast(self.epochs)
        named = self.pairs.join(e.select(F.col("t").alias("i"), F.col("q").alias("d1")), "i").join(e.select(F.col("t").alias("j"), F.col("q").alias("d2")), "j")
        return named.select("p", "i", "j", "d1", "d2", F.concat_ws("_", F.date_format("d1", "yyyyMMdd"), F.date_format("d2", "yyyyMMdd")).alias("name"))

    @cached_property
    def obs(self) -> DataFrame:
        """y, x, p, i, j, ph, coh: every pair at every pixel, NULL where there is no data."""
        # A pixel's series is one array, so a pair is two look-ups: one scan, no join.
        packed = series.pack_series(self.cum.select("y", "x", "t", "d"), len(self.epoch_rows))
        listed = F.explode(network.constant(self.pair_rows, ("p", "i", "j"))).alias("k")
        both = packed.select("y", "x", "d", listed).select("y", "x", "k.p", "k.i", "k.j", F.get("d", F.col("k.i")).alias("di"), F.get("d", F.col("k.j")).alias("dj")).where("di is not null and dj is not null")
        ok = "(7*x + 13*y + 31*i + 17*j) % 23 <> 0 AND NOT ((x + 2*y) % 7 = 0 AND i <= 9 AND j > 9)"
        jump = "CASE WHEN (x + 3*y + 5*i + 7*j) % 7 = 0 AND (i + 2*j) % 13 = 0 THEN 6.283185307179586D ELSE 0D END"
        noise = "0.01D * ((x*x + 3*y*y + 5*i*x + 7*j*y) % 17 - 8)"
        return both.select("y", "x", "p", "i", "j", F.expr(f"CASE WHEN {ok} THEN nullif((dj - di) / {COEF}D + {jump} + {noise}, 0D) END").alias("ph"), F.expr("nullif((37*x + 17*y + 11*i + 5*j) % 256, 0) / 255D").alias("coh"))

    @cached_property
    def heights(self) -> DataFrame:
        """y, x, hgt: mean retail price of a pixel's parts, from whole cents."""
        parts = self.table("part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
        lines = self.table("lineitem").select((F.col("l_suppkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), F.col("l_partkey").alias("p_partkey")).groupBy("y", "x", "p_partkey").count()
        return lines.join(parts, "p_partkey").groupBy("y", "x").agg((F.sum(F.col("cents") * F.col("count")) / F.sum("count") / 100).alias("hgt"))

    @cached_property
    def points(self) -> DataFrame:
        """pid, lat, lon; some lie outside the grid."""
        return self.table("supplier").select(F.col("s_suppkey").alias("pid"), (F.lit(41.0) - 0.01 * (F.col("s_suppkey") % 12)).alias("lat"), (F.lit(14.0) + 0.01 * (F.col("s_nationkey") % 12)).alias("lon"))

    @cached_property
    def los(self) -> DataFrame:
        """geom, y, x, e, n, u, disp of three looks at ew = 3 + x - 2 y, ud = 5 - x + y."""
        grid = self.spark.range(SIDE * SIDE).select((F.col("id") / SIDE).cast("int").alias("y"), (F.col("id") % SIDE).cast("int").alias("x"))
        looks = F.explode(F.array(*[F.struct(F.lit(g).alias("geom"), F.lit(e).alias("e"), F.lit(n).alias("n")) for g, e, n in LOOKS]))
        up = F.sqrt(1 - F.col("n") * F.col("n") - F.col("e") * F.col("e"))
        hole = (F.col("geom") == "c") & ((F.col("x") + F.col("y")) % 3 == 0)
        return grid.select("y", "x", looks.alias("k")).select("y", "x", "k.*").withColumn("u", up).select("geom", "y", "x", "e", "n", "u", F.when(~hole, F.col("e") * (3 + F.col("x") - 2 * F.col("y")) + F.col("u") * (5 - F.col("x") + F.col("y"))).alias("disp"))


LOOKS = [("a", 0.6, -0.1), ("b", -0.6, -0.1), ("c", 0.5, -0.12)]

#: The same views in DuckDB SQL.
SQL = f"""
WITH li AS (SELECT CAST(l_suppkey % {SIDE} AS INT) AS y, CAST(l_partkey % {SIDE} AS INT) AS x, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) AS q, CAST(l_quantity AS BIGINT) AS n, l_partkey FROM lineitem),
epochs AS (SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS INT) AS t, q, date_diff('day', min(q) OVER (), q) / 365.25::DOUBLE AS yr FROM (SELECT DISTINCT q FROM li)),
cell AS (SELECT y, x, t, yr, CAST(sum(n) AS DOUBLE) / count(*) + 2 * (x - y) * yr AS c FROM li JOIN epochs USING (q) GROUP BY y, x, t, yr),
cum AS (SELECT a.y, a.x, a.t, a.yr, a.c - b.c AS d FROM cell a JOIN cell b ON a.y = b.y AND a.x = b.x AND b.t = 0),
pairs AS (SELECT CAST(row_number() OVER (ORDER BY a.t, b.t) - 1 AS INT) AS p, a.t AS i, b.t AS j FROM epochs a JOIN epochs b ON b.t - a.t BETWEEN 1 AND {REACH}),
names AS (SELECT p, i, j, a.q AS d1, b.q AS d2, strftime(a.q, '%Y%m%d') || '_' || strftime(b.q, '%Y%m%d') AS name FROM pairs JOIN epochs a ON a.t = i JOIN epochs b ON b.t = j),
loops AS (SELECT CAST(row_number() OVER (ORDER BY a.p, b.p) - 1 AS INT) AS l, a.p AS p12, b.p AS p23, c.p AS p13, a.i AS a, a.j AS b, b.j AS c FROM pairs a JOIN pairs b ON a.j = b.i JOIN pairs c ON c.i = a.i AND c.j = b.j),
obs AS (SELECT a.y, a.x, p, i, j,
  CASE WHEN (7*a.x + 13*a.y + 31*i + 17*j) % 23 <> 0 AND NOT ((a.x + 2*a.y) % 7 = 0 AND i <= 9 AND j > 9)
  THEN nullif((b.d - a.d) / {COEF}::DOUBLE + CASE WHEN (a.x + 3*a.y + 5*i + 7*j) % 7 = 0 AND (i + 2*j) % 13 = 0 THEN 6.283185307179586::DOUBLE ELSE 0 END + 0.01::DOUBLE * ((a.x*a.x + 3*a.y*a.y + 5*i*a.x + 7*j*a.y) % 17 - 8), 0) END AS ph,
  nullif((37*a.x + 17*a.y + 11*i + 5*j) % 256, 0) / 255::DOUBLE AS coh
  FROM pairs JOIN cum a ON a.t = i JOIN cum b ON b.t = j AND a.y = b.y AND a.x = b.x),
heights AS (SELECT y, x, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS hgt FROM li JOIN part ON p_partkey = l_partkey GROUP BY y, x),
points AS (SELECT s_suppkey AS pid, 41.0::DOUBLE - 0.01::DOUBLE * (s_suppkey % 12) AS lat, 14.0::DOUBLE + 0.01::DOUBLE * (s_nationkey % 12) AS lon FROM supplier),
px AS (SELECT CAST(id // {SIDE} AS INT) AS y, CAST(id % {SIDE} AS INT) AS x FROM range({SIDE * SIDE}) r(id)),
los AS (SELECT geom, y, x, e, n, u, CASE WHEN NOT (geom = 'c' AND (x + y) % 3 = 0) THEN e * (3 + x - 2 * y) + u * (5 - x + y) END AS disp
  FROM (SELECT y, x, geom, e, n, sqrt(1 - n * n - e * e) AS u FROM px, (VALUES {', '.join(f"('{g}', {e}::DOUBLE, {n}::DOUBLE)" for g, e, n in LOOKS)}) v(geom, e, n)))
"""
