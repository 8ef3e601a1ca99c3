"""The engine's queries over a synthetic stack, each with its DuckDB counterpart where SQL can express it independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantstack.functions import scalar as S
from slantstack.model import Box, Grid, Sensor, Thresholds, parse_range
from slantstack.operators import closure, contour, correct, decide, detrend, invert, los, network, raster, series, smooth

from .stack import COEF, SQL, Stack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SENSOR, GRID = Sensor(), Grid()
#: Reference box, window for dates, thresholds of the loop test.
REF, START, END, LOOP = Box(2, 5, 1, 4), "1993-02-01", "1996-11-15", 1.5
#: Mask rule of the fixtures: a pixel is masked where this is 0.
MASK = "(x * 3 + y * 5) % 7"
DELAY = "0.05 * ((x + 2 * y + 3 * t) % 11) - 0.2"
BPERP = "((t * 37) % 101) / 10"
R = S.rounded
c = F.col


def query(name: str, sql: str | None = None):
    """Register a function of a Stack; sql follows the stack's views (a leading comma adds views of its own)."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Stack(spark, sf_dir))
        if sql:
            ORACLES[name] = SQL + sql
        return f

    return put


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def mask_of(st: Stack) -> DataFrame:
    return st.cum.select("y", "x").distinct().select("y", "x", F.expr(f"CAST({MASK} <> 0 AS INT)").alias("mask"))


def delays_of(st: Stack) -> DataFrame:
    return st.cum.select("y", "x", "t").where("t % 9 <> 4").select("t", "y", "x", F.expr(f"CAST({DELAY} AS DOUBLE)").alias("delay"))


def files_of(st: Stack) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("m")) for m, k in enumerate(correct.SOURCES, 2)]))
    return st.epochs.select("t", kinds.alias("k")).select("t", "k.*").where("(t + m) % (m + 1) <> 0").select("t", "kind")


FILES = ", files AS (SELECT t, kind FROM epochs, (VALUES ('slant_tif', 2), ('zenith_tif', 3), ('zenith_flat', 4)) k(kind, m) WHERE (t + m) % (m + 1) <> 0)"
DELAYS = f", delays AS (SELECT t, y, x, CAST({DELAY} AS DOUBLE) AS delay FROM cum WHERE t % 9 <> 4)"
PHI = ", phases AS (SELECT a.y, a.x, l, a.ph + b.ph - c.ph AS phi FROM loops JOIN obs a ON a.p = p12 JOIN obs b ON b.p = p23 AND b.y = a.y AND b.x = a.x JOIN obs c ON c.p = p13 AND c.y = a.y AND c.x = a.x WHERE a.ph + b.ph - c.ph IS NOT NULL), med AS (SELECT l, median(phi) AS med FROM phases GROUP BY l), phc AS (SELECT y, x, l, phi - round_even(med / (2 * pi()), 0) * 2 * pi() AS phi FROM phases JOIN med USING (l)), rated AS (SELECT l, p12, p23, p13, coalesce(n, 0) AS n, coalesce(rms, 'inf'::DOUBLE) AS rms FROM loops LEFT JOIN (SELECT l, count(*) AS n, sqrt(avg(phi * phi)) AS rms FROM phc GROUP BY l) USING (l))"
LP = "(SELECT l, rms, unnest([p12, p23, p13]) AS p FROM rated)"
BAD1 = f", bad1 AS (SELECT DISTINCT p FROM {LP} WHERE rms >= {LOOP} AND p NOT IN (SELECT p FROM {LP} WHERE rms < {LOOP}))"
PX = ", stats AS (SELECT y, x, count(*) AS n_loop, count(*) FILTER (phi * phi > pi() * pi()) AS n_bad, sqrt(avg(phi * phi)) AS rms FROM phc GROUP BY y, x), counts AS (SELECT y, x, count(ph) AS n_unw FROM obs GROUP BY y, x)"
REFP = f", ref AS (SELECT p, avg(ph) FILTER (x >= {REF.x1} AND x < {REF.x2} AND y >= {REF.y1} AND y < {REF.y2}) AS ref FROM obs GROUP BY p), base AS (SELECT l, a.ref + b.ref - c.ref AS base FROM loops JOIN ref a ON a.p = p12 JOIN ref b ON b.p = p23 JOIN ref c ON c.p = p13)"
AREA = f", area AS (SELECT t, avg(d) AS ref FROM cum WHERE x >= {REF.x1} AND x < {REF.x2} AND y >= {REF.y1} AND y < {REF.y2} GROUP BY t)"


# --- sources and network -------------------------------------------------------------------------------------------


@query("src08_pair_names", "SELECT name FROM names WHERE name[1] = '2' AND name[10] = '2'")
def _(st):
    return network.pairs_from_paths(st.pair_names.select(F.concat(F.lit("/data/"), "name").alias("path")))


@query("src09_epochs", f"SELECT t, CAST(q AS VARCHAR) AS d, {r('yr')} AS yr FROM epochs")
def _(st):
    return network.epochs_of(st.pair_names).select("t", c("d").cast("string").alias("d"), R(c("yr"), 6).alias("yr"))


@query("joi01_pair_index", "SELECT p, i, j, name FROM names")
def _(st):
    return network.index_pairs(st.pair_names.select("name"), st.epochs.select("t", c("q").alias("d")))


@query("joi02_triangles", "SELECT * FROM loops")
def _(st):
    return network.triangles(st.pairs)


@query("joi12_pairs_without_bad", "SELECT p, i, j FROM pairs WHERE p % 5 <> 2")
def _(st):
    return network.minus(st.pairs, st.pairs.where("p % 5 = 2"))


@query("la01_design_increments", "SELECT p, CAST(unnest(range(i, j)) AS INT) AS k FROM pairs")
def _(st):
    return network.increments(st.pairs)


@query("la02_design_cumulative", "SELECT p, i AS t, -1 AS sign FROM pairs UNION ALL SELECT p, j, 1 FROM pairs")
def _(st):
    return network.signed_epochs(st.pairs)


@query("agg14_loop_counts", "SELECT p, i, j, (SELECT count(*) FROM loops WHERE p IN (p12, p23, p13)) AS n_loop FROM pairs")
def _(st):
    return network.loop_counts(st.pairs, network.triangles(st.pairs))


@query("agg14_pairs_without_loop", "SELECT p, i, j FROM pairs WHERE p NOT IN (SELECT unnest([p12, p23, p13]) FROM loops JOIN pairs k ON k.p = p13 WHERE k.i % 4 <> 0)")
def _(st):
    loops = network.triangles(st.pairs).where("a % 4 <> 0").drop("a", "b", "c")
    return network.without_loop(st.pairs, loops)


BROKEN = "NOT (i <= 9 AND j > 9) AND NOT (i <= 20 AND j > 20)"


@query("win09_network_gaps", f"SELECT t AS k, CAST(count(p) = 0 AS INT) AS is_gap, count(p) AS n_span FROM epochs LEFT JOIN (SELECT * FROM pairs WHERE {BROKEN}) ON i <= t AND t < j WHERE t < (SELECT max(t) FROM epochs) GROUP BY t")
def _(st):
    return network.gaps(st.pairs.where(BROKEN), st.epochs)


@query("agg23_segments", f"SELECT seg, min(t) AS first_t, max(t) AS last_t, count(*) AS n_epoch, {r('max(yr) - min(yr)')} AS years FROM (SELECT t, yr, (t > 9)::BIGINT + (t > 20)::BIGINT AS seg FROM epochs) GROUP BY seg")
def _(st):
    return network.segments(st.pairs.where(BROKEN), st.epochs).withColumn("years", R(c("years"), 6))


@query("win10_gap_middles", "SELECT a.t AS k, CAST(CAST(a.q + CAST(floor(date_diff('day', a.q, b.q) / 2) AS INT) AS DATE) AS VARCHAR) AS mid FROM epochs a JOIN epochs b ON b.t = a.t + 1 WHERE a.t IN (9, 20)")
def _(st):
    return network.gap_middles(st.pairs.where(BROKEN), st.epochs).select("k", c("mid").cast("string").alias("mid"))


@query("set01_pair_difference", "SELECT p FROM pairs WHERE p % 3 <> 0")
def _(st):
    return network.minus(st.pairs.select("p"), st.pairs.where("p % 3 = 0"))


@query("set02_bad_union", "SELECT p FROM pairs WHERE p % 3 = 0 OR p % 5 = 0")
def _(st):
    return network.merged(st.pairs.where("p % 3 = 0"), st.pairs.where("p % 5 = 0"))


@query("set03_candidates_minus_good", "SELECT p FROM pairs WHERE p % 3 = 0 EXCEPT SELECT p FROM pairs WHERE p % 2 = 0")
def _(st):
    return st.pairs.where("p % 3 = 0").select("p").subtract(st.pairs.where("p % 2 = 0").select("p"))


@query("set04_unused_epochs", "SELECT t, CAST(q AS VARCHAR) AS q FROM epochs WHERE t NOT IN (SELECT i FROM pairs WHERE i % 5 <> 0 AND j % 5 <> 0 UNION SELECT j FROM pairs WHERE i % 5 <> 0 AND j % 5 <> 0)")
def _(st):
    return network.unused_epochs(st.epochs, st.pairs.where("i % 5 <> 0 AND j % 5 <> 0")).select("t", c("q").cast("string").alias("q"))


@query("set05_remaining_candidates", "SELECT p FROM pairs WHERE p % 2 = 0 AND p % 3 <> 0 AND p % 5 <> 0")
def _(st):
    return network.minus(st.pairs.where("p % 2 = 0").select("p"), network.merged(st.pairs.where("p % 3 = 0"), st.pairs.where("p % 5 = 0")))


@query("set06_common_pixels", f"SELECT DISTINCT y, x FROM cum WHERE {MASK} <> 0 AND (x + y) % 2 = 0")
def _(st):
    return mask_of(st).where("mask <> 0").select("y", "x").intersect(st.cum.where("(x + y) % 2 = 0").select("y", "x"))


@query("set07_scatter_points", "SELECT DISTINCT round(hgt, 0) AS h, round_even(d, 0) + 0.0 AS v FROM heights JOIN cum USING (y, x) WHERE t = 9")
def _(st):
    both = st.heights.join(st.cum.where("t = 9"), ["y", "x"])
    return both.select(F.round("hgt", 0).alias("h"), (F.rint("d") + F.lit(0.0)).alias("v")).distinct()


@query("src10_baselines", f", b AS (SELECT t, CAST({BPERP} AS DOUBLE) AS bperp FROM epochs) SELECT p, date_diff('day', d1, d2) AS dt, {r('y.bperp - x.bperp')} AS dbperp FROM names JOIN b x ON x.t = i JOIN b y ON y.t = j")
def _(st):
    b = st.epochs.select("t", F.expr(f"CAST({BPERP} AS DOUBLE)").alias("bperp"))
    return network.baselines(st.pairs, b, st.epochs).select("p", c("dt").cast("long").alias("dt"), R(c("dbperp"), 6).alias("dbperp"))


@query("qry16_dummy_baselines", f"SELECT t, {r('CASE WHEN t = 0 THEN 0 WHEN t % 4 = 1 THEN u + 0.5 WHEN t % 4 = 2 THEN -0.5 - u WHEN t % 4 = 3 THEN u ELSE -u END')} AS bperp FROM (SELECT t, ((t * 7919 + 104729) % 1000) / 2000::DOUBLE AS u FROM epochs)")
def _(st):
    return network.dummy_baselines(st.epochs).select("t", R(c("bperp"), 6).alias("bperp"))


@query("qry08_network", f"SELECT name, i, j, p NOT IN (SELECT p FROM pairs WHERE p % 7 = 3) AS good, {r('a.yr')} AS yr1, {r('b.yr')} AS yr2 FROM names JOIN epochs a ON a.t = i JOIN epochs b ON b.t = j")
def _(st):
    e = F.broadcast(st.epochs.select("t", "yr"))
    n = st.pair_names.join(e.select(c("t").alias("i"), c("yr").alias("yr1")), "i").join(e.select(c("t").alias("j"), c("yr").alias("yr2")), "j")
    return n.select("name", "i", "j", (c("p") % 7 != 3).alias("good"), R(c("yr1"), 6).alias("yr1"), R(c("yr2"), 6).alias("yr2"))


@query("src18_pairs_in_dates", f"SELECT name FROM names WHERE d1 >= DATE '{START}' AND d2 <= DATE '{END}'")
def _(st):
    return st.pair_names.where((c("d1") >= F.lit(START).cast("date")) & (c("d2") <= F.lit(END).cast("date"))).select("name")


@query("flt09_snap_window", f"SELECT min(t) FILTER (q >= DATE '{START}') AS t1, max(t) FILTER (q <= DATE '{END}') AS t2 FROM epochs")
def _(st):
    return series.snap_window(st.epochs, START, END)


@query("joi14_nearest_epoch", f"SELECT t FROM epochs ORDER BY abs(date_diff('day', DATE '{END}', q)), t LIMIT 1")
def _(st):
    return series.nearest_epoch(st.epochs, END)


@query("top05_latest_with_layer", FILES + " SELECT max(t) AS t FROM files WHERE kind = 'zenith_tif' AND t <= 22")
def _(st):
    return correct.latest_with_layer(files_of(st), "zenith_tif", 22)


@query("src16_choose_source", FILES + " SELECT t, (SELECT kind FROM files f WHERE f.t = e.t ORDER BY list_position(['slant_tif', 'zenith_tif', 'zenith_flat'], kind) LIMIT 1) AS source FROM epochs e")
def _(st):
    return correct.choose_source(st.epochs, files_of(st))


LISTS = ("(t * 13) % 7", "CASE WHEN t % 5 = 1 THEN 9 ELSE (t * 13) % 7 END", "t * 3", "CASE WHEN t % 4 = 0 THEN t * 3 - 1 ELSE t * 3 END")


@query("src19_freshness", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN rs IS NULL THEN 3 WHEN ls IS NULL THEN 4 WHEN rs <> ls THEN 1 WHEN rm > lm THEN 2 ELSE 0 END AS code
FROM (SELECT CAST(q AS VARCHAR) AS path, {LISTS[0]} AS rs, {LISTS[2]} AS rm FROM epochs WHERE t % 6 <> 2) a FULL JOIN (SELECT CAST(q AS VARCHAR) AS path, {LISTS[1]} AS ls, {LISTS[3]} AS lm FROM epochs WHERE t % 6 <> 3) b ON a.path = b.path""")
def _(st):
    side = lambda size, mtime, skip: st.epochs.where(f"t % 6 <> {skip}").select(c("q").cast("string").alias("path"), F.expr(size).alias("size"), F.expr(mtime).alias("mtime"))
    return correct.freshness(side(LISTS[0], LISTS[2], 2), side(LISTS[1], LISTS[3], 3))


# --- projections and filters ---------------------------------------------------------------------------------------


@query("prj01_no_data", "SELECT p, count(ph) AS n FROM (SELECT p, nullif(CASE WHEN ph IS NULL THEN 0 ELSE ph END, 0) AS ph FROM obs) GROUP BY p")
def _(st):
    return st.obs.select("p", S.clean(F.coalesce("ph", F.lit(0.0))).alias("ph")).groupBy("p").agg(F.count("ph").alias("n"))


@query("prj02_millimetres", f"SELECT y, x, p, {r(f'ph * {SENSOR.mm_per_radian!r}::DOUBLE', 5)} AS mm FROM obs")
def _(st):
    return st.obs.select("y", "x", "p", R(S.to_mm(c("ph"), SENSOR), 5).alias("mm"))


@query("prj03_delay_phase", DELAYS + f" SELECT t, y, x, {r(f'delay / u * {4 * 3.141592653589793 / SENSOR.wavelength!r}::DOUBLE', 5)} AS rad FROM delays JOIN los USING (y, x) WHERE geom = 'a'")
def _(st):
    up = st.los.where("geom = 'a'").select("y", "x", "u")
    return delays_of(st).join(up, ["y", "x"]).select("t", "y", "x", R(S.delay_to_phase(c("delay"), c("u"), SENSOR), 5).alias("rad"))


@query("prj04_wrapped", f"SELECT y, x, p, {r('atan2(sin(ph / 3), cos(ph / 3))')} AS w FROM obs")
def _(st):
    return st.obs.select("y", "x", "p", R(S.wrapped(c("ph"), SENSOR.wrap_cycle), 6).alias("w"))


@query("prj05_variance", f"SELECT y, x, p, CASE WHEN coh IS NOT NULL THEN {r('(1 - g * g) / (2 * g * g)', 5)} END AS var FROM (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, coh)) AS g FROM obs)")
def _(st):
    return st.obs.select("y", "x", "p", R(S.variance(c("coh")), 5).alias("var"))


@query("prj06_year_fraction", f"SELECT t, {r('yr', 8)} AS yr FROM epochs")
def _(st):
    return st.epochs.select("t", R(S.year_fraction(c("q"), F.min("q").over(_all())), 8).alias("yr"))


def _all():
    from pyspark.sql import Window

    return Window.orderBy("q").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


@query("prj07_nearest_pixel", "SELECT pid, CAST(CASE WHEN ok THEN y END AS DOUBLE) AS y, CAST(CASE WHEN ok THEN x END AS DOUBLE) AS x FROM (SELECT *, y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9 AS ok FROM (SELECT pid, CAST(round_even((lat - 41.0) / -0.01, 0) AS INT) AS y, CAST(round_even((lon - 14.0) / 0.01, 0) AS INT) AS x FROM points))")
def _(st):
    return raster.locate(st.points, GRID).select("pid", c("y").cast("double").alias("y"), c("x").cast("double").alias("x"))


@query("prj08_pixel_position", f"SELECT y, x, {r('41.0::DOUBLE + y * -0.01::DOUBLE', 8)} AS lat, {r('14.0::DOUBLE + x * 0.01::DOUBLE', 8)} AS lon FROM px")
def _(st):
    return st.los.select("y", "x").distinct().select("y", "x", R(S.latitude(c("y"), GRID), 8).alias("lat"), R(S.longitude(c("x"), GRID), 8).alias("lon"))


@query("prj09_spacing", f"SELECT {r('2 * pi() * 6378137 * (1 - 1 / 298.2572236) / 360 * 0.01', 4)} AS north, {r('2 * pi() * 6378137 / 360 * 0.01 * cos(radians(41.0 - 0.05))', 4)} AS east")
def _(st):
    north, east = GRID.spacing_m()
    return st.spark.range(1).select(R(F.lit(north), 4).alias("north"), R(F.lit(east), 4).alias("east"))


@query("prj10_incidence", f"SELECT geom, y, x, {r('degrees(acos(u))')} AS deg FROM los")
def _(st):
    return st.los.select("geom", "y", "x", R(S.incidence(c("u")), 6).alias("deg"))


@query("prj15_log_intensity", f"SELECT y, x, {r('log10(hgt)')} AS v FROM heights")
def _(st):
    return st.heights.select("y", "x", R(S.log_intensity(c("hgt")), 6).alias("v"))


@query("prj19_zoom_and_colour", "SELECT y, x, CASE WHEN m <= 5 THEN 17 WHEN m <= 10 THEN 16 WHEN m <= 20 THEN 15 WHEN m <= 40 THEN 14 WHEN m <= 80 THEN 13 WHEN m <= 160 THEN 12 ELSE 11 END AS zoom, CAST(greatest(0, least(63, floor((hgt - 1300) / (1600 - 1300) * 64))) AS INT) AS level, CAST(pow(2, 6) AS INT) - y - 1 AS tms_row FROM (SELECT *, 2.5 * (1 + (x + 10 * y) % 80) AS m FROM heights)")
def _(st):
    return st.heights.select("y", "x", S.zoom_level(2.5 * (1 + (c("x") + 10 * c("y")) % 80)).alias("zoom"), S.colour_index(c("hgt"), 1300.0, 1600.0, 64).alias("level"), S.flipped_tile_row(c("y"), F.lit(6)).alias("tms_row"))


@query("prj16_sizes", "SELECT t, CASE WHEN n < 1024 THEN CAST(round_even(n, 2) AS VARCHAR) || 'B' WHEN n < pow(1024, 2) THEN CAST(round_even(n / 1024, 2) AS VARCHAR) || 'KB' WHEN n < pow(1024, 3) THEN CAST(round_even(n / pow(1024, 2), 2) AS VARCHAR) || 'MB' WHEN n < pow(1024, 4) THEN CAST(round_even(n / pow(1024, 3), 2) AS VARCHAR) || 'GB' ELSE CAST(round_even(n / pow(1024, 4), 2) AS VARCHAR) || 'TB' END AS size FROM (SELECT t, CAST(pow(3, t) AS DOUBLE) AS n FROM epochs)")
def _(st):
    return st.epochs.select("t", S.human_size(F.pow(F.lit(3.0), c("t"))).alias("size"))


@query("str06_parameter_rewrite", r" SELECT pid, regexp_replace(regexp_replace('width:   ' || pid || chr(10) || 'nlines: 12' || chr(10) || 'corner_lat: 41.0000 degrees', 'width:\s*10', 'width: 4', 'g'), 'corner_lat:\s*41\.0', 'corner_lat: 40.9', 'g') AS text FROM points")
def _parameter_rewrite(st):
    text = F.concat(F.lit("width:   "), c("pid").cast("string"), F.lit("\nnlines: 12\ncorner_lat: 41.0000 degrees"))
    return st.points.select("pid", S.with_parameter(S.with_parameter(text, "width", "10", "4"), "corner_lat", "41.0", "40.9").alias("text"))


@query("str08_reference_box", " SELECT pid, CAST(pid % 7 AS INT) AS x1, CAST(pid % 7 + 2 AS INT) AS x2, CAST(pid % 5 AS INT) AS y1, CAST(pid % 5 + 1 AS INT) AS y2 FROM points")
def _reference_box(st):
    text = F.format_string("%d:%d/%d:%d", c("pid") % 7, c("pid") % 7 + 2, c("pid") % 5, c("pid") % 5 + 1)
    return st.points.select("pid", S.range_ends(F.encode(text, "UTF-8")).alias("b")).select("pid", "b.*")


@query("str09_output_names", " SELECT name, name || '.vstd' AS vstd, name || '.amp' AS amp, name || '.dt' AS dt FROM names")
def _output_names(st):
    vel = F.concat("name", F.lit(".vel"))
    return st.pair_names.select("name", *[S.output_name(vel, k).alias(k) for k in ("vstd", "amp", "dt")])


@query("str01_pair_dates", "SELECT name, CAST(d1 AS VARCHAR) AS d1, CAST(d2 AS VARCHAR) AS d2, CAST(date_diff('day', d1, d2) AS INT) AS days, CAST(dayofyear(d1) - 1 AS INT) AS offset_day FROM names")
def _(st):
    n = st.pair_names.select("name", S.primary_date(c("name")).alias("d1"), S.secondary_date(c("name")).alias("d2"))
    return n.select("name", c("d1").cast("string").alias("d1"), c("d2").cast("string").alias("d2"), F.date_diff("d2", "d1").alias("days"), (F.dayofyear("d1") - 1).alias("offset_day"))


@query("flt01_mask_boxes", "SELECT y, x, t, CASE WHEN NOT ((x >= 2 AND x < 5 AND y >= 1 AND y < 3) OR (x >= 7 AND y >= 8)) THEN round(d, 6) + 0.0 END AS d FROM cum")
def _(st):
    boxes = [parse_range("2:5/1:3", GRID.width, GRID.length), parse_range("7:0/8:0", GRID.width, GRID.length)]
    return raster.mask_box(st.cum, boxes, "d").select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("flt02_clip", f"SELECT y - 1 AS y, x - 2 AS x, t, {r('d')} AS d FROM cum WHERE x >= 2 AND x < 5 AND y >= 1 AND y < 4")
def _(st):
    return raster.clip(st.cum, REF).select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("flt03_coherence_mask", "SELECT y, x, p, CASE WHEN m > 0.49 THEN round(ph, 6) + 0.0 END AS ph FROM obs JOIN (SELECT y, x, coalesce(avg(nullif(coh, 0)), 0) AS m FROM obs GROUP BY y, x) USING (y, x)")
def _(st):
    return raster.mask_coherence(st.obs, 0.49).select("y", "x", "p", R(c("ph"), 6).alias("ph"))


@query("flt04_mask_raster", f"SELECT y, x, t, CASE WHEN {MASK} <> 0 THEN round(d, 6) + 0.0 END AS d FROM cum")
def _(st):
    return raster.mask_with(st.cum, mask_of(st), "d").select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("flt06_enough_pairs", "SELECT y, x, count(ph) AS n FROM obs GROUP BY y, x HAVING count(ph) > CAST(floor(2.65 * (SELECT count(*) FROM epochs)) AS INT)")
def _(st):
    return st.obs.groupBy("y", "x").agg(F.count("ph").alias("n")).where(c("n") > int(2.65 * len(st.epoch_rows)))


@query("flt07_pixels_with_data", " SELECT y, x, count(ph) AS n FROM obs WHERE (x + y) % 4 <> 0 GROUP BY y, x HAVING count(ph) > 0")
def _with_data(st):
    holes = st.obs.withColumn("ph", F.when((c("x") + c("y")) % 4 != 0, c("ph")))
    return raster.with_data(closure.pack(holes, len(st.pair_rows)), "ph").select("y", "x", F.size(F.filter("ph", lambda v: v.isNotNull())).cast("long").alias("n"))


@query("flt08_first_epoch_valid", "SELECT y, x, count(*) AS n FROM cum WHERE (y, x) IN (SELECT (y, x) FROM cum WHERE t = 0 AND d IS NOT NULL) GROUP BY y, x")
def _(st):
    packed = series.pack_series(st.cum, 28).where(F.get("d", F.lit(0)).isNotNull())
    return packed.select("y", "x", F.size(F.filter("d", lambda v: v.isNotNull())).cast("long").alias("n"))


@query("flt10_no_data_values", "SELECT y, x, t, coalesce(nullif(round(d, 3) + 0.0, 0), -9999) AS v FROM cum")
def _(st):
    return st.cum.select("y", "x", "t", F.coalesce(F.nullif(R(c("d"), 3), F.lit(0.0)), F.lit(-9999.0)).alias("v"))


# --- rasters -------------------------------------------------------------------------------------------------------


@query("spa01_block_means", f"SELECT t, y // 2 AS y, x // 5 AS x, CASE WHEN count(v) >= 5 THEN {r('avg(v)')} END AS v FROM (SELECT *, CASE WHEN (x * 3 + y * 5 + t) % 7 > 2 THEN d END AS v FROM cum) GROUP BY t, y // 2, x // 5")
def _(st):
    holes = st.cum.withColumn("v", F.when(F.expr("(x * 3 + y * 5 + t) % 7 > 2"), c("d")))
    return raster.block_means(holes, 2, 5, GRID, ("t",)).withColumn("v", R(c("v"), 6))


@query("spa01_block_means_ragged", f"SELECT y // 3 AS y, x // 4 AS x, CASE WHEN count(hgt) >= 6 THEN {r('avg(hgt)')} END AS hgt FROM heights WHERE y < 9 AND x < 8 GROUP BY y // 3, x // 4")
def _(st):
    return raster.block_means(st.heights, 3, 4, GRID, value="hgt").withColumn("hgt", R(c("hgt"), 6))


@query("spa02_quantised_coherence", "SELECT y, x, p, CAST(coalesce(floor(coh * 255), 0) AS INT) AS q FROM (SELECT y, x, p, nullif(CAST((37*x + 17*y + 11*i + 5*j) % 256 AS DOUBLE), 0) / 256 AS coh FROM obs)")
def _(st):
    return st.obs.select("y", "x", "p", S.quantised(F.expr("nullif(CAST((37*x + 17*y + 11*i + 5*j) % 256 AS DOUBLE), 0D) / 256")).alias("q"))


HOLES = "CASE WHEN (x * y + x) % 5 = 0 THEN 0 ELSE hgt END"


@query("spa03_fill_holes", f", h AS (SELECT y, x, {HOLES} AS v FROM heights) SELECT a.y, a.x, {r('CASE WHEN a.v <> 0 THEN a.v ELSE coalesce(avg(nullif(b.v, 0)), 0) END', 5)} AS v FROM h a LEFT JOIN h b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY a.y, a.x, a.v")
def _(st):
    return raster.fill_holes(st.heights.select("y", "x", F.expr(f"CAST({HOLES} AS DOUBLE)").alias("v"))).select("y", "x", R(c("v"), 5).alias("v"))


@query("spa04_neighbour_consistency", f"""{", steps AS (SELECT y, x, t, d - lag(d) OVER (PARTITION BY y, x ORDER BY t) AS s, t - lag(t) OVER (PARTITION BY y, x ORDER BY t) AS dt FROM cum)"}
SELECT p.y, p.x, {r('min(nullif(rms, 0))')} AS stc FROM (SELECT DISTINCT y, x FROM cum) p LEFT JOIN
(SELECT a.y, a.x, sqrt(avg(pow(a.s - b.s, 2))) AS rms FROM steps a JOIN steps b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x)
WHERE a.dt = 1 AND b.dt = 1 GROUP BY a.y, a.x, b.y, b.x) n ON n.y = p.y AND n.x = p.x GROUP BY p.y, p.x""")
def _(st):
    return series.consistency(series.pack_series(st.cum, 28)).withColumn("stc", R(c("stc"), 6))


@query("qry04_point_values", f""", spot AS (SELECT pid, lat, lon, CASE WHEN y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9 THEN y END AS y, CASE WHEN y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9 THEN x END AS x FROM (SELECT *, CAST(round_even((lat - 41.0) / -0.01, 0) AS INT) AS y, CAST(round_even((lon - 14.0) / 0.01, 0) AS INT) AS x FROM points))
SELECT pid, CAST(a.y AS DOUBLE) AS y, CAST(a.x AS DOUBLE) AS x, {r('max(CASE WHEN h.y = a.y AND h.x = a.x THEN hgt END)')} AS value, {r('avg(hgt)')} AS mean FROM spot a LEFT JOIN heights h ON abs(h.y - a.y) <= 1 AND abs(h.x - a.x) <= 1 GROUP BY pid, a.y, a.x""")
def _(st):
    return raster.values_at(st.points, st.heights, GRID, 3, "hgt").select("pid", c("y").cast("double").alias("y"), c("x").cast("double").alias("x"), R(c("value"), 6).alias("value"), R(c("mean"), 6).alias("mean"))


@query("qry05_profile", f""", s AS (SELECT CAST(s AS INT) AS s, CAST(round_even(1 + s / 8::DOUBLE * 7, 0) AS INT) AS x, CAST(round_even(9 - s / 8::DOUBLE * 7, 0) AS INT) AS y FROM range(9) g(s))
SELECT s, x, y, {r('s / 8::DOUBLE * floor(sqrt(pow(7 * e, 2) + pow(7 * n, 2)))', 3)} AS distance, {r('hgt')} AS hgt FROM s LEFT JOIN heights USING (y, x), (SELECT 2 * pi() * 6378137 * (1 - 1 / 298.2572236::DOUBLE) / 360 * 0.01 AS n, 2 * pi() * 6378137 / 360 * 0.01 * cos(radians(41.0 - 0.01 * 5.5)) AS e)""")
def _(st):
    return raster.profile(st.heights, (1, 9, 8, 2), GRID, "hgt").select("s", "x", "y", R(c("distance"), 3).alias("distance"), R(c("hgt"), 6).alias("hgt"))


@query("spa09_bilinear", f""", g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, 0.25 + y * 0.5 AS fy, 0.5 + x * 0.75 AS fx FROM range(12) a(y), range(10) b(x)),
k AS (SELECT *, CAST(least(floor(fy), 8) AS INT) AS y0, CAST(least(floor(fx), 8) AS INT) AS x0 FROM g)
SELECT k.y, k.x, CASE WHEN count(hgt) = 4 THEN {r('sum(hgt * CASE WHEN h.y = y0 THEN 1 - (fy - y0) ELSE fy - y0 END * CASE WHEN h.x = x0 THEN 1 - (fx - x0) ELSE fx - x0 END)', 5)} END AS v FROM k LEFT JOIN heights h ON h.y BETWEEN y0 AND y0 + 1 AND h.x BETWEEN x0 AND x0 + 1 AND fy <= 9 AND fx <= 9 GROUP BY k.y, k.x""")
def _(st):
    target = Grid(10, 12, 41.0 - 0.0025, 14.005, -0.005, 0.0075)
    return raster.resample_bilinear(st.heights, GRID, target, "hgt").select("y", "x", R(c("hgt"), 5).alias("v"))


@query("agg18_percentiles", f"SELECT {r('quantile_cont(d, 0.01)')} AS low, {r('quantile_cont(d, 0.99)')} AS high FROM cum")
def _(st):
    return raster.percentiles(st.cum, 1, 99, "d").select(R(c("low"), 6).alias("low"), R(c("high"), 6).alias("high"))


@query("agg20_range", f"SELECT {r('min(d)')} AS low, {r('max(d)')} AS high FROM cum")
def _(st):
    return st.cum.agg(R(F.min("d"), 6).alias("low"), R(F.max("d"), 6).alias("high"))


FEATURES = "SELECT CAST(t % 5 AS INT) * 10 AS level, t % 4 + 1 AS n FROM epochs"


@query("flt11_contours", f"SELECT level, n FROM ({FEATURES}) WHERE level <> 0 AND n > 2")
def _(st):
    f = st.epochs.select((c("t") % 5 * 10).alias("level"), F.sequence(F.lit(0), c("t") % 4).alias("coords"))
    return contour.filtered(f, 2, drop_zero=True).select("level", F.size("coords").alias("n"))


@query("agg24_contour_summary", f"SELECT count(*) AS n_feature, CAST(sum(n) AS BIGINT) AS n_node FROM ({FEATURES})")
def _(st):
    return contour.summary(st.epochs.select((c("t") % 5 * 10).alias("level"), F.sequence(F.lit(0), c("t") % 4).alias("coords")))


# --- pair and pixel quality ----------------------------------------------------------------------------------------


@query("agg01_n_unw", "SELECT y, x, count(ph) AS n_unw FROM obs GROUP BY y, x")
def _(st):
    return closure.unwrap_counts(st.obs)


@query("agg02_coherence_mean", f"SELECT y, x, {r('avg(nullif(coh, 0))')} AS coh_avg FROM obs GROUP BY y, x")
def _(st):
    return raster.coherence_mean(st.obs).withColumn("coh_avg", R(c("coh_avg"), 6))


@query("agg03_valid_area", "SELECT y, x, count(ph) AS n_unw FROM obs GROUP BY y, x HAVING count(ph) >= (SELECT count(*) FROM epochs)")
def _(st):
    return closure.unwrap_counts(st.obs).where(c("n_unw") >= len(st.epoch_rows))


AREA0 = ", area0 AS (SELECT y, x FROM obs GROUP BY y, x HAVING count(ph) >= (SELECT count(*) FROM epochs)), quality AS (SELECT p, coalesce(n, 0)::DOUBLE / nullif((SELECT count(*) FROM area0), 0) AS coverage, coherence FROM pairs LEFT JOIN (SELECT p, count(ph) AS n, avg(nullif(coh, 0)) AS coherence FROM obs JOIN area0 USING (y, x) GROUP BY p) USING (p))"


@query("agg04_pair_quality", AREA0 + f" SELECT p, {r('coverage')} AS coverage, {r('coherence')} AS coherence FROM quality")
def _(st):
    return decide.pair_quality(closure.pack(st.obs, len(st.pair_rows)), st.pairs, len(st.epoch_rows)).select("p", R(c("coverage"), 6).alias("coverage"), R(c("coherence"), 6).alias("coherence"))


@query("qc01_bad_pairs", AREA0 + " SELECT p, NOT coalesce(coverage >= 0.9 AND coherence >= 0.4, false) AS bad FROM quality")
def _(st):
    return decide.bad_pairs(decide.pair_quality(closure.pack(st.obs, len(st.pair_rows)), st.pairs, len(st.epoch_rows)), 0.9, 0.4).select("p", "bad")


@query("agg15_correction_effect", DELAYS + f", corr AS (SELECT p, a.y, a.x, b.delay - a.delay AS corr FROM pairs JOIN delays a ON a.t = i JOIN delays b ON b.t = j AND b.y = a.y AND b.x = a.x), k AS (SELECT p, ph AS before, ph - corr AS ph FROM obs JOIN corr USING (p, y, x) WHERE ph IS NOT NULL) SELECT p, {r('stddev_pop(before)')} AS std_before, {r('stddev_pop(ph)')} AS std_after, {r('(stddev_pop(before) - stddev_pop(ph)) / nullif(stddev_pop(before), 0) * 100', 4)} AS rate FROM k GROUP BY p")
def _(st):
    k = correct.corrected(st.obs, correct.pair_corrections(st.pairs, delays_of(st)))
    return correct.effect(k).select("p", R(c("std_before"), 6).alias("std_before"), R(c("std_after"), 6).alias("std_after"), R(c("rate"), 4).alias("rate"))


@query("joi04_pair_corrections", DELAYS + f" SELECT p, a.y, a.x, {r('b.delay - a.delay')} AS corr FROM pairs JOIN delays a ON a.t = i JOIN delays b ON b.t = j AND b.y = a.y AND b.x = a.x")
def _(st):
    return correct.pair_corrections(st.pairs, delays_of(st)).withColumn("corr", R(c("corr"), 6))


@query("joi04_uncorrectable", "SELECT p, i, j FROM pairs WHERE i % 9 = 4 OR j % 9 = 4")
def _(st):
    return correct.uncorrectable(st.pairs, delays_of(st))


# --- loop closure --------------------------------------------------------------------------------------------------


def _net(st):
    n = len(st.pair_rows)
    loops = network.local(network.triangles(st.pairs))
    packed = closure.pack(st.obs, n)
    return loops, packed, closure.without_cycles(closure.loop_phase(packed, loops))


@query("joi03_loop_phase", PHI + f" SELECT y, x, l, {r('phi')} AS phi FROM phases")
def _(st):
    loops = network.local(network.triangles(st.pairs))
    return closure.loop_phase(closure.pack(st.obs, len(st.pair_rows)), loops).select("y", "x", "l", R(c("phi"), 6).alias("phi"))


@query("agg06_loop_rms", PHI + f" SELECT l, p12, p23, p13, n, {r('rms')} AS rms FROM rated")
def _(st):
    loops, _, ph = _net(st)
    return closure.loop_rms(ph, loops).withColumn("rms", R(c("rms"), 6))


@query("agg06_loop_rms_multi_prime", PHI + f" SELECT l, {r('sqrt(avg(pow(phi - med, 2)))')} AS rms FROM phases JOIN med USING (l) GROUP BY l")
def _(st):
    loops = network.local(network.triangles(st.pairs))
    ph = closure.without_cycles(closure.loop_phase(closure.pack(st.obs, len(st.pair_rows)), loops), multi_prime=True)
    return ph.groupBy("l").agg(R(F.sqrt(F.avg(c("phi") * c("phi"))), 6).alias("rms"))


@query("qc02_bad_pairs", PHI + BAD1 + " SELECT p FROM bad1")
def _(st):
    loops, _, ph = _net(st)
    return closure.bad_pairs(closure.loop_rms(ph, loops), LOOP)


@query("qc03_manual_removal", PHI + BAD1 + " SELECT p FROM bad1 UNION SELECT p FROM pairs WHERE p % 11 = 5")
def _(st):
    loops, _, ph = _net(st)
    return network.merged(closure.bad_pairs(closure.loop_rms(ph, loops), LOOP), st.pairs.where("p % 11 = 5"))


@query("agg07_pixel_loops", PHI + PX + f" SELECT y, x, n_loop, n_bad, {r('rms')} AS rms FROM stats")
def _(st):
    return closure.pixel_stats(_net(st)[2]).withColumn("rms", R(c("rms"), 6))


@query("top02_reference_pixel", PHI + PX + " SELECT y, x FROM stats JOIN counts USING (y, x) WHERE rms > 0 AND n_unw = (SELECT max(n_unw) FROM counts) ORDER BY n_bad, rms, y, x LIMIT 1")
def _(st):
    return closure.reference_pixel(closure.pixel_stats(_net(st)[2]), closure.unwrap_counts(st.obs))


@query("agg10_reference_phase", REFP + f" SELECT p, {r('ref')} AS ref FROM ref")
def _(st):
    return closure.reference_phase(st.obs, REF).withColumn("ref", R(c("ref"), 6))


ONE = Box(3, 4, 6, 7)


@query("qc05_pairs_without_reference", f"SELECT p FROM obs GROUP BY p HAVING count(ph) FILTER (x = {ONE.x1} AND y = {ONE.y1}) = 0")
def _(st):
    return closure.pairs_without_reference(closure.reference_phase(st.obs, ONE))


@query("agg09_referenced_rms", PHI + REFP + f" SELECT l, {r('rms')} AS rms FROM loops LEFT JOIN (SELECT l, sqrt(avg(pow(phi - base, 2))) AS rms FROM phases JOIN base USING (l) GROUP BY l) USING (l)")
def _(st):
    loops = network.local(network.triangles(st.pairs))
    ph = closure.loop_phase(closure.pack(st.obs, len(st.pair_rows)), loops)
    return closure.referenced_loop_rms(ph, closure.reference_phase(st.obs, REF), loops).select("l", R(c("rms"), 6).alias("rms"))


RATED3 = ", rated AS (SELECT l, p12, p23, p13, rms FROM loops LEFT JOIN (SELECT l, sqrt(avg(pow(phi - base, 2))) AS rms FROM phases JOIN base USING (l) GROUP BY l) USING (l))"
PHASES = PHI[: PHI.index(", med AS")]


@query("qc06_bad_after_reference", PHASES + REFP + RATED3 + f" SELECT DISTINCT p FROM {LP} WHERE rms >= 0.8 AND p NOT IN (SELECT p FROM {LP} WHERE rms < 0.8)")
def _(st):
    loops = network.local(network.triangles(st.pairs))
    ph = closure.loop_phase(closure.pack(st.obs, len(st.pair_rows)), loops)
    return closure.bad_pairs(closure.referenced_loop_rms(ph, closure.reference_phase(st.obs, REF), loops), 0.8)


@query("agg08_loop_errors", PHI + REFP + " SELECT y, x, count(*) FILTER (abs(phi - base) > pi()) AS n_loop_err FROM phases JOIN base USING (l) GROUP BY y, x")
def _(st):
    loops = network.local(network.triangles(st.pairs))
    ph = closure.loop_phase(closure.pack(st.obs, len(st.pair_rows)), loops)
    return closure.loop_errors(ph, closure.reference_phase(st.obs, REF), loops)


@query("qc08_loop_flags", PHI + BAD1 + REFP.replace("rated", "rated_") + f""", rated3 AS (SELECT l, p12, p23, p13, rms FROM loops LEFT JOIN (SELECT l, sqrt(avg(pow(phi - base, 2))) AS rms FROM phases JOIN base USING (l) GROUP BY l) USING (l)),
lp3 AS (SELECT unnest([p12, p23, p13]) AS p, rms FROM rated3), noref AS (SELECT p FROM obs GROUP BY p HAVING count(ph) FILTER (x = {ONE.x1} AND y = {ONE.y1}) = 0),
bad3 AS (SELECT DISTINCT p FROM lp3 WHERE rms >= 0.8 AND p NOT IN (SELECT p FROM lp3 WHERE rms < 0.8)), manual AS (SELECT p FROM pairs WHERE p % 17 = 4),
cand AS (SELECT p FROM lp3 WHERE rms >= 0.8 EXCEPT (SELECT p FROM bad1 UNION SELECT p FROM manual UNION SELECT p FROM noref UNION SELECT p FROM bad3)),
held AS (SELECT l, bool_or(p IN (SELECT p FROM bad1)) AS a, bool_or(p IN (SELECT p FROM manual)) AS b, bool_or(p IN (SELECT p FROM noref)) AS c, bool_or(p IN (SELECT p FROM bad3)) AS d, bool_or(p IN (SELECT p FROM cand)) AS e FROM (SELECT l, unnest([p12, p23, p13]) AS p FROM loops) GROUP BY l)
SELECT l, CASE WHEN a THEN '*' WHEN b THEN '+' WHEN c THEN '**' WHEN d THEN '***' WHEN e THEN '/' ELSE '' END AS flag FROM held""")
def _(st):
    loops, packed, ph = _net(st)
    bad1 = closure.bad_pairs(closure.loop_rms(ph, loops), LOOP)
    third = closure.referenced_loop_rms(closure.loop_phase(packed, loops), closure.reference_phase(st.obs, REF), loops)
    manual, noref, bad3 = st.pairs.where("p % 17 = 4").select("p"), closure.pairs_without_reference(closure.reference_phase(st.obs, ONE)), closure.bad_pairs(third, 0.8)
    candidates = closure.remaining_candidates(third, network.merged(bad1, manual, noref, bad3), 0.8)
    return closure.loop_flags(loops, bad1, manual, noref, bad3, candidates)


@query("agg12_gap_counts", "SELECT y, x, CAST(count(*) FILTER (n = 0) AS INT) AS n_gap FROM (SELECT y, x, t, count(ph) FILTER (i <= t AND t < j) AS n FROM obs, (SELECT t FROM epochs WHERE t < (SELECT max(t) FROM epochs)) GROUP BY y, x, t) GROUP BY y, x")
def _(st):
    return closure.gap_counts(closure.gap_flags(closure.pack(st.obs, len(st.pair_rows)), st.pairs, len(st.epoch_rows)))


@query("agg13_no_loop_counts", PHI + " SELECT y, x, CAST(count(ph) - count(DISTINCT CASE WHEN ph IS NOT NULL THEN q END) AS INT) AS n_noloop FROM obs o LEFT JOIN (SELECT DISTINCT y AS qy, x AS qx, unnest([p12, p23, p13]) AS q FROM phases JOIN loops USING (l)) k ON k.qy = y AND k.qx = x AND q = p GROUP BY y, x")
def _(st):
    return closure.no_loop_counts(closure.pack(st.obs, len(st.pair_rows)), network.triangles(st.pairs))


@query("win04_longest_run", f""", g AS (SELECT y, x, t, count(ph) FILTER (i <= t AND t < j) = 0 AS gap FROM obs, (SELECT t FROM epochs WHERE t < (SELECT max(t) FROM epochs)) GROUP BY y, x, t),
s AS (SELECT y, x, gap, b.yr - a.yr AS d, sum(gap::INT) OVER (PARTITION BY y, x ORDER BY g.t) AS seg FROM g JOIN epochs a ON a.t = g.t JOIN epochs b ON b.t = g.t + 1)
SELECT y, x, {r('max(n)')} AS max_run FROM (SELECT y, x, seg, sum(CASE WHEN gap THEN 0 ELSE d END) AS n FROM s GROUP BY y, x, seg) GROUP BY y, x""")
def _(st):
    gap = closure.gap_flags(closure.pack(st.obs, len(st.pair_rows)), st.pairs, len(st.epoch_rows))
    return closure.longest_run(gap, st.years).withColumn("max_run", R(c("max_run"), 6))


# --- inversion -----------------------------------------------------------------------------------------------------


def _inverted(st, **kw):
    packed = closure.pack(st.obs, len(st.pair_rows))
    return packed, invert.invert(packed, st.pairs, st.years, coef=COEF, **kw)


@query("la03_invert", None)
def _(st):
    return _inverted(st)[1].select("y", "x", R(c("vel"), 4).alias("vel"), R(c("const"), 4).alias("const"), R(c("resid_rms"), 4).alias("resid_rms"))


@query("la04_invert_chain", f"SELECT a.y, a.x, CAST(a.t - 1 AS INT) AS k, {r('a.d - b.d', 5)} AS inc FROM cum a JOIN cum b ON b.y = a.y AND b.x = a.x AND b.t = a.t - 1")
def _(st):
    chain = st.pairs.where("j = i + 1").select(c("i").alias("p"), "i", "j")
    steps = st.cum.select("y", "x", c("t").alias("j"), "d").join(F.broadcast(chain), "j").join(st.cum.select("y", "x", c("t").alias("i"), c("d").alias("d0")), ["y", "x", "i"])
    packed = closure.pack(steps.select("y", "x", "p", ((c("d") - c("d0")) / COEF).alias("ph"), F.lit(None).cast("double").alias("coh")), chain.count())
    inv = invert.invert(packed, chain, st.years, coef=COEF, gamma=1e-6)
    return inv.select("y", "x", F.posexplode("inc").alias("k", "inc")).select("y", "x", "k", R(c("inc"), 5).alias("inc"))


@query("la05_invert_weighted", None)
def _(st):
    return _inverted(st, weighted=True)[1].select("y", "x", R(c("vel"), 4).alias("vel"), R(c("resid_rms"), 4).alias("resid_rms"))


@query("la06_residuals", None)
def _(st):
    return _inverted(st)[1].select("y", "x", F.posexplode("resid").alias("p", "r")).select("y", "x", "p", R(c("r"), 4).alias("resid"))


@query("agg11_pair_residuals", None)
def _(st):
    return invert.pair_rms(_inverted(st)[1]).withColumn("rms", R(c("rms"), 4))


@query("win01_displacement", None)
def _(st):
    packed, inv = _inverted(st)
    gap = closure.gap_flags(packed, st.pairs, len(st.epoch_rows))
    return invert.long_series(invert.accumulate(inv, gap), st.years).select("y", "x", "t", R(c("d"), 4).alias("d"))


# --- series --------------------------------------------------------------------------------------------------------


@query("la07_velocity", f"SELECT y, x, count(d) AS n, {r('regr_slope(d, yr)', 5)} AS vel, {r('regr_intercept(d, yr)', 5)} AS vintercept FROM cum GROUP BY y, x")
def _(st):
    return series.velocity(st.cum).select("y", "x", "n", R(c("vel"), 5).alias("vel"), R(c("vintercept"), 5).alias("vintercept"))


@query("agg17_area_series", AREA + f" SELECT t, {r('ref')} AS ref FROM area")
def _(st):
    return series.area_series(st.cum, REF).withColumn("ref", R(c("ref"), 6))


VEL = AREA + f" SELECT y, x, count(d) AS n, {r('regr_slope(d - ref, yr)', 5)} AS vel, {r('regr_intercept(d - ref, yr)', 5)} AS vintercept FROM cum JOIN area USING (t) {{}} GROUP BY y, x"


@query("qry03_velocity_map", VEL.format(""))
def _(st):
    v = series.velocity(series.rereference(st.cum, series.area_series(st.cum, REF)))
    return v.select("y", "x", "n", R(c("vel"), 5).alias("vel"), R(c("vintercept"), 5).alias("vintercept"))


@query("qry03_velocity_window", f", win AS (SELECT min(t) FILTER (q >= DATE '{START}') AS t1, max(t) FILTER (q <= DATE '{END}') AS t2 FROM epochs) SELECT y, x, {r('regr_slope(d, yr)', 5)} AS vel FROM cum, win WHERE t BETWEEN t1 AND t2 GROUP BY y, x")
def _(st):
    w = series.snap_window(st.epochs, START, END)
    part = st.cum.join(F.broadcast(w), c("t").between(c("t1"), c("t2")))
    return series.velocity(part).select("y", "x", R(c("vel"), 5).alias("vel"))


@query("qry01_date_difference", AREA + f", k AS (SELECT y, x, max(CASE WHEN t = 20 THEN d - ref END) - max(CASE WHEN t = 5 THEN d - ref END) AS v FROM cum JOIN area USING (t) GROUP BY y, x) SELECT y, x, CASE WHEN {MASK} <> 0 THEN round(v, 6) + 0.0 END AS v FROM k")
def _(st):
    moved = series.from_epoch(series.rereference(st.cum, series.area_series(st.cum, REF)).where("t IN (5, 20)"), 5).where("t = 20").withColumnRenamed("d", "v")
    return raster.mask_with(moved, mask_of(st), "v").select("y", "x", R(c("v"), 6).alias("v"))


@query("qry02_point_series", AREA + f" SELECT t, {r('d - ref - first_value(d - ref) OVER (ORDER BY t)')} AS d FROM cum JOIN area USING (t) WHERE y = 7 AND x = 3")
def _(st):
    point = st.cum.where("y = 7 AND x = 3")
    return series.zero_first(series.rereference(point, series.area_series(st.cum, REF))).select("t", R(c("d"), 6).alias("d"))


@query("qry09_viewer_map", AREA + f" SELECT y, x, {r('d - ref')} AS d FROM cum JOIN area USING (t) WHERE t = (SELECT t FROM epochs ORDER BY abs(date_diff('day', DATE '{END}', q)), t LIMIT 1)")
def _(st):
    now = st.cum.join(F.broadcast(series.nearest_epoch(st.epochs, END)), "t", "left_semi")
    return series.rereference(now, series.area_series(st.cum, REF)).select("y", "x", R(c("d"), 6).alias("d"))


@query("win02_increments", f"SELECT y, x, t, {r('d - lag(d) OVER (PARTITION BY y, x ORDER BY t)')} AS inc FROM cum QUALIFY t > 0")
def _(st):
    return series.increments(st.cum).withColumn("inc", R(c("inc"), 6))


@query("win06_from_date", f"SELECT a.y, a.x, a.t, {r('a.d - b.d')} AS d FROM cum a LEFT JOIN cum b ON b.y = a.y AND b.x = a.x AND b.t = 12")
def _(st):
    return series.from_epoch(st.cum, 12).select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("win07_zero_first", f"SELECT y, x, t, {r('d - first_value(d) OVER (PARTITION BY y, x ORDER BY t)')} AS d FROM cum WHERE t >= 3")
def _(st):
    return series.zero_first(st.cum.where("t >= 3")).select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("win11_row_numbers", "SELECT y, x, row_number() OVER (ORDER BY y, x) AS n FROM (SELECT DISTINCT y, x FROM cum)")
def _(st):
    return st.cum.select("y", "x").distinct().select("y", "x", (c("y") * 0 + F.row_number().over(_rows())).cast("long").alias("n"))


def _rows():
    from pyspark.sql import Window

    return Window.orderBy("y", "x")


@query("joi13_compare_series", f", med AS (SELECT t, avg(d) AS m FROM cum GROUP BY t) SELECT y, x, t, {r('d')} AS d1, {r('d - m')} AS d2 FROM cum JOIN med USING (t) WHERE y = 2 AND x = 6")
def _(st):
    other = series.rereference(st.cum, st.cum.groupBy("t").agg(F.avg("d").alias("ref"))).withColumnRenamed("d", "d2").drop("yr")
    return st.cum.where("y = 2 AND x = 6").join(other, ["y", "x", "t"]).select("y", "x", "t", R(c("d"), 6).alias("d1"), R(c("d2"), 6).alias("d2"))


@query("agg16_spatial_rms", f", med AS (SELECT t, median(d) AS m FROM cum GROUP BY t) SELECT y, x, CASE WHEN count(d) = (SELECT count(*) FROM epochs) THEN {r('sqrt(sum(pow(d - m, 2)) / (SELECT count(*) FROM epochs))')} END AS rms FROM cum JOIN med USING (t) GROUP BY y, x")
def _(st):
    return series.spatial_rms(st.cum, len(st.epoch_rows)).withColumn("rms", R(c("rms"), 6))


STABLE = f", med AS (SELECT t, median(d) AS m FROM cum GROUP BY t), k AS (SELECT y, x, CASE WHEN count(d) = (SELECT count(*) FROM epochs) THEN sqrt(avg(pow(d - m, 2))) END AS rms FROM cum JOIN med USING (t) GROUP BY y, x), g AS (SELECT y, x, {MASK} AS n_gap FROM k), stable AS (SELECT y, x FROM k JOIN g USING (y, x) WHERE rms IS NOT NULL AND n_gap = (SELECT min(n_gap) FROM g) ORDER BY rms, y, x LIMIT 1)"


def _stable(st):
    gaps = st.cum.select("y", "x").distinct().withColumn("n_gap", F.expr(MASK))
    return series.stable_pixel(series.spatial_rms(st.cum, len(st.epoch_rows)), gaps)


@query("top03_stable_pixel", STABLE + " SELECT y, x FROM stable")
def _(st):
    return _stable(st)


@query("qc15_stable_reference", STABLE + f" SELECT c.y, c.x, c.t, {r('c.d - s.d')} AS d FROM cum c JOIN cum s ON s.t = c.t AND (s.y, s.x) IN (SELECT (y, x) FROM stable)")
def _(st):
    return series.rereference(st.cum, series.at_pixel(st.cum, _stable(st))).select("y", "x", "t", R(c("d"), 6).alias("d"))


@query("la08_annual", None)
def _(st):
    return series.annual(st.cum).select("y", "x", *[R(c(n), 4).alias(n) for n in ("vel", "vintercept", "amplitude", "peak_day")])


@query("la16_point_models", None)
def _(st):
    parts = [series.point_model(st.cum.where("y = 4 AND x = 8"), m).withColumn("model", F.lit(m)) for m in series.MODELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("fitted", R(c("fitted"), 4))


@query("la09_velocity_std", f""", draws AS (SELECT b, CAST((b * 7919 + k * 104729 + (b * k * k) % 7907) % 28 AS INT) AS t FROM range(100) a(b), range(28) e(k)), m AS (SELECT b, t, count(*) AS w FROM draws GROUP BY b, t),
s AS (SELECT y, x, b, sum(w)::DOUBLE AS n, sum(w * yr) AS st, sum(w * d) AS sd, sum(w * yr * yr) AS stt, sum(w * yr * d) AS std FROM cum JOIN m USING (t) GROUP BY y, x, b)
SELECT y, x, {r('stddev_pop(CASE WHEN n * stt - st * st > 1e-9 THEN (n * std - st * sd) / (n * stt - st * st) END)', 5)} AS vstd FROM s GROUP BY y, x""")
def _(st):
    return series.velocity_std(st.cum, 28, 100).withColumn("vstd", R(c("vstd"), 5))


# --- masks ---------------------------------------------------------------------------------------------------------

LIMITS = Thresholds(coh_avg=0.46, n_unw=70.0, vstd=0.6, n_loop_err=3.0)


def _stats(st):
    v = series.velocity(st.cum).select("y", "x", "vel")
    parts = (raster.coherence_mean(st.obs), closure.unwrap_counts(st.obs), series.velocity_std(st.cum, 28, 100))
    for p in parts:
        v = v.join(p, ["y", "x"], "left")
    return v


STATS = ORACLES["la09_velocity_std"].removeprefix(SQL)
BOARD = STATS[: STATS.index("\nSELECT y, x,")] + f""", vs AS (SELECT y, x, stddev_pop(CASE WHEN n * stt - st * st > 1e-9 THEN (n * std - st * sd) / (n * stt - st * st) END) AS vstd FROM s GROUP BY y, x), v AS (SELECT y, x, regr_slope(d, yr) AS vel FROM cum GROUP BY y, x), o AS (SELECT y, x, avg(coh) AS coh_avg, count(ph) AS n_unw FROM obs GROUP BY y, x),
board AS (SELECT y, x, vel, coalesce(coh_avg >= {LIMITS.coh_avg}, false)::INT AS a, coalesce(n_unw >= {LIMITS.n_unw}, false)::INT AS b, coalesce(vstd <= {LIMITS.vstd}, false)::INT AS k FROM v LEFT JOIN o USING (y, x) LEFT JOIN vs USING (y, x))"""


@query("qc10_mask_board", BOARD + " SELECT y, x, a AS keep_coh_avg, b AS keep_n_unw, k AS keep_vstd, CASE WHEN vel IS NOT NULL THEN a * b * k END AS mask FROM board")
def _(st):
    return decide.mask_board(_stats(st), LIMITS).select("y", "x", "keep_coh_avg", "keep_n_unw", "keep_vstd", "mask")


@query("agg19_mask_report", BOARD + " SELECT criterion, count(*) AS n, round(100.0 * count(*) FILTER (v = 0) / count(*), 4) + 0.0 AS masked_percent FROM (SELECT unnest([{'criterion': 'coh_avg', 'v': a}, {'criterion': 'n_unw', 'v': b}, {'criterion': 'vstd', 'v': k}, {'criterion': 'mask', 'v': a * b * k}], recursive := true) FROM board WHERE vel IS NOT NULL) GROUP BY criterion")
def _(st):
    return decide.mask_report(decide.mask_board(_stats(st), LIMITS)).withColumn("masked_percent", R(c("masked_percent"), 4))


@query("qc14_masked_velocity", BOARD + f" SELECT y, x, CASE WHEN a * b * k = 1 THEN {r('vel', 5)} END AS vel_masked FROM board")
def _(st):
    s = _stats(st)
    return decide.apply_mask(s.select("y", "x", "vel"), decide.mask_board(s, LIMITS)).select("y", "x", R(c("vel_masked"), 5).alias("vel_masked"))


@query("qc11_adjusted_thresholds", "SELECT 'coh_avg' AS criterion, -ceil(-max(m)) AS threshold FROM (SELECT avg(coh) AS m FROM obs GROUP BY y, x)")
def _(st):
    limits, changed = decide.adjusted(raster.coherence_mean(st.obs), Thresholds(coh_avg=1.5))
    return st.spark.createDataFrame([(k, getattr(limits, k)) for k in changed], "criterion string, threshold double")


@query("qc12_isolated_pixels", "SELECT y, x, CAST(x % 3 <> 0 AS INT) AS keep FROM px")
def _(st):
    s = st.los.select("y", "x").distinct().withColumn("stc", F.when(c("x") % 3 != 0, 1.0))
    return decide.mask_board(s, Thresholds(), keep_isolated=False).select("y", "x", c("keep_stc").alias("keep"))


# --- detrending and smoothing --------------------------------------------------------------------------------------

MOMENTS = f", s AS (SELECT t, count(*)::DOUBLE n, sum(x)::DOUBLE sx, sum(y)::DOUBLE sy, sum(x*x)::DOUBLE sxx, sum(x*y)::DOUBLE sxy, sum(y*y)::DOUBLE syy, sum(d) sd, sum(x*d) sxd, sum(y*d) syd FROM cum WHERE {MASK} <> 0 GROUP BY t), dt AS (SELECT *, n*(sxx*syy-sxy*sxy) - sx*(sx*syy-sxy*sy) + sy*(sx*sxy-sxx*sy) AS det FROM s), k AS (SELECT t, (sd*(sxx*syy-sxy*sxy) - sx*(sxd*syy-sxy*syd) + sy*(sxd*sxy-sxx*syd))/det AS a, (n*(sxd*syy-sxy*syd) - sd*(sx*syy-sxy*sy) + sy*(sx*syd-sxd*sy))/det AS b, (n*(sxx*syd-sxd*sxy) - sx*(sx*syd-sxd*sy) + sd*(sx*sxy-sxx*sy))/det AS c FROM dt)"


@query("la12_ramp", MOMENTS + f" SELECT t, {r('a', 4)} AS one, {r('b', 4)} AS x, {r('c', 4)} AS y FROM k")
def _(st):
    return detrend.coefficients(st.cum, "1", mask=mask_of(st)).select("t", *[R(c(f"b_{n}"), 4).alias(n) for n in ("one", "x", "y")])


@query("la13_detrended", MOMENTS + f" SELECT y, x, t, {r('d - a - b * x - c * y', 4)} AS d FROM cum JOIN k USING (t)")
def _(st):
    k = detrend.coefficients(st.cum, "1", mask=mask_of(st))
    return detrend.detrended(st.cum, k, "1").select("y", "x", "t", R(c("d"), 4).alias("d"))


@query("la12_height", f", k AS (SELECT t, regr_slope(d, CASE WHEN hgt BETWEEN 1000 AND 2000 THEN hgt ELSE 0 END) AS b, regr_intercept(d, CASE WHEN hgt BETWEEN 1000 AND 2000 THEN hgt ELSE 0 END) AS a FROM cum JOIN heights USING (y, x) GROUP BY t) SELECT y, x, t, {r('d - a - b * hgt', 3)} AS d FROM cum JOIN heights USING (y, x) JOIN k USING (t) WHERE t > 0")
def _(st):
    h = st.cum.join(st.heights, ["y", "x"])
    return detrend.detrended(h, detrend.coefficients(h, None, (1000.0, 2000.0)), None, (1000.0, 2000.0)).where("t > 0").select("y", "x", "t", R(c("d"), 3).alias("d"))


@query("la12_ramp_bilinear", None)
def _(st):
    return detrend.coefficients(st.cum, "bl").select("t", "n", *[R(c(f"b_{n}"), 4).alias(n) for n in detrend.RAMPS["bl"]])


@query("la12_ramp_quadratic_height", None)
def _(st):
    h = st.cum.join(st.heights, ["y", "x"])
    return detrend.coefficients(h, "2", (1000.0, 2000.0)).select("t", "n", *[R(c(f"b_{n}"), 3).alias(n) for n in (*detrend.RAMPS["2"], "hgt")])


@query("la13_deramp_effect", MOMENTS + f", e AS (SELECT t, stddev_pop(d) AS s0, stddev_pop(d - a - b * x - c * y) AS s1 FROM cum JOIN k USING (t) WHERE t > 0 GROUP BY t) SELECT t, {r('s0', 4)} AS std_before, {r('s1', 4)} AS std_after, {r('(s0 - s1) / s0 * 100', 3)} AS rate FROM e")
def _(st):
    k = detrend.coefficients(st.cum, "1", mask=mask_of(st))
    return detrend.reduction(st.cum.where("t > 0"), detrend.detrended(st.cum, k, "1").where("t > 0")).select("t", R(c("std_before"), 4).alias("std_before"), R(c("std_after"), 4).alias("std_after"), R(c("rate"), 3).alias("rate"))


SIGMA_T, SIGMA_Y, SIGMA_X = 0.4, 1.2, 0.8
LOW = f", w AS (SELECT a.t AS t0, b.t, exp(-pow(a.yr - b.yr, 2) / {2 * SIGMA_T * SIGMA_T}::DOUBLE) AS w FROM epochs a JOIN epochs b ON pow(a.yr - b.yr, 2) < {8 * SIGMA_T}::DOUBLE), lp AS (SELECT y, x, t0 AS t, sum(w * d) / sum(w) AS lp FROM cum JOIN w USING (t) GROUP BY y, x, t0)"


@query("win08_temporal_smooth", LOW + f" SELECT y, x, t, {r('lp', 5)} AS lp, {r('d - lp', 5)} AS hp FROM cum JOIN lp USING (y, x, t)")
def _(st):
    return smooth.temporal(st.cum, st.epochs, SIGMA_T).select("y", "x", "t", R(c("lp"), 5).alias("lp"), R(c("hp"), 5).alias("hp"))


_G = f"exp(-pow(a.y - b.y, 2) / {2 * SIGMA_Y * SIGMA_Y}::DOUBLE - pow(a.x - b.x, 2) / {2 * SIGMA_X * SIGMA_X}::DOUBLE)"


@query("spa08_spatial_smooth", f", v AS (SELECT y, x, CASE WHEN {MASK} <> 0 THEN hgt END AS v FROM heights) SELECT a.y, a.x, {r(f'sum({_G} * b.v) / sum({_G})', 5)} AS lp FROM v a JOIN v b ON b.v IS NOT NULL AND abs(a.y - b.y) <= 5 AND abs(a.x - b.x) <= 4 GROUP BY a.y, a.x")
def _(st):
    v = st.heights.select("y", "x", F.expr(f"CASE WHEN {MASK} <> 0 THEN hgt END").alias("v"))
    return smooth.spatial(v, SIGMA_Y, SIGMA_X).withColumn("lp", R(c("lp"), 5))


@query("spa08_filtered_series", LOW + f", h AS (SELECT y, x, t, d, d - lp AS hp FROM cum JOIN lp USING (y, x, t)) SELECT a.y, a.x, a.t, {r(f'max(a.d) - sum({_G} * b.hp) / sum({_G})', 5)} AS d FROM h a JOIN h b ON b.t = a.t AND abs(a.y - b.y) <= 5 AND abs(a.x - b.x) <= 4 GROUP BY a.y, a.x, a.t")
def _(st):
    return smooth.filtered(st.cum, st.epochs, SIGMA_T, SIGMA_Y, SIGMA_X).select("y", "x", "t", R(c("d"), 5).alias("d"))


# --- looks ---------------------------------------------------------------------------------------------------------

LOOKS = f", s AS (SELECT y, x, count(disp) FILTER (e > 0) AS n_plus, count(disp) FILTER (e < 0) AS n_minus, count(disp) AS n, sum(e*e) FILTER (disp IS NOT NULL) AS ee, sum(e*u) FILTER (disp IS NOT NULL) AS eu, sum(u*u) FILTER (disp IS NOT NULL) AS uu, sum(e*disp) AS ed, sum(u*disp) AS ud FROM los WHERE NOT (geom = 'b' AND x = 9) GROUP BY y, x), sol AS (SELECT y, x, n_plus, n_minus, n, CASE WHEN n_plus > 0 AND n_minus > 0 THEN (uu*ed - eu*ud) / (ee*uu - eu*eu) END AS ew, CASE WHEN n_plus > 0 AND n_minus > 0 THEN (ee*ud - eu*ed) / (ee*uu - eu*eu) END AS ud FROM s)"


@query("la14_decompose", LOOKS + f" SELECT y, x, n_plus, n_minus, n, {r('ew', 5)} AS ew, {r('ud', 5)} AS ud FROM sol")
def _(st):
    return los.decompose(los.require_sides(st.los.where("NOT (geom = 'b' AND x = 9)"))).select("y", "x", "n_plus", "n_minus", "n", R(c("ew"), 5).alias("ew"), R(c("ud"), 5).alias("ud"))


@query("la14_residuals", LOOKS + f" SELECT geom, l.y, l.x, {r('disp - e * ew - u * s.ud', 5)} AS resid FROM los l JOIN sol s ON s.y = l.y AND s.x = l.x WHERE s.n >= 3")
def _(st):
    v = st.los.where("NOT (geom = 'b' AND x = 9)")
    return los.residuals(st.los, los.decompose(v)).withColumn("resid", R(c("resid"), 5))


@query("la15_up_component", f"SELECT geom, y, x, {r('nullif(sqrt(greatest(0, 1 - n * n - e * e)), 0)')} AS u FROM los")
def _(st):
    return st.los.select("geom", "y", "x", R(S.los_up(c("e"), c("n")), 6).alias("u"))


@query("spa10_common_area", f", ext AS (SELECT geom, e, 41.0 - 0.01 * (ascii(geom) % 3) AS lat1, 40.9 + 0.01 * (ascii(geom) % 2) AS lat2, 14.0 + 0.01 * (ascii(geom) % 4) AS lon1, 14.1 - 0.01 * (ascii(geom) % 3) AS lon2, 0.001 * (1 + ascii(geom) % 3) AS dlat, 0.001 * (1 + ascii(geom) % 2) AS dlon FROM (SELECT DISTINCT geom, e FROM los)), sides AS (SELECT e > 0 AS side, max(lat1) n, min(lat2) s, min(lon1) w, max(lon2) east, max(dlat) dlat, max(dlon) dlon FROM ext GROUP BY e > 0) SELECT {r('CAST(min(n) AS DOUBLE)')} AS north, {r('CAST(max(s) AS DOUBLE)')} AS south, {r('CAST(max(w) AS DOUBLE)')} AS west, {r('CAST(min(east) AS DOUBLE)')} AS east, {r('CAST(max(dlat) AS DOUBLE)')} AS dlat, {r('CAST(max(dlon) AS DOUBLE)')} AS dlon, count(*) AS n_sides FROM sides")
def _(st):
    a = F.ascii("geom")
    ext = st.los.select("geom", "e").distinct().select("geom", "e", (41.0 - 0.01 * (a % 3)).alias("lat1"), (40.9 + 0.01 * (a % 2)).alias("lat2"), (14.0 + 0.01 * (a % 4)).alias("lon1"), (14.1 - 0.01 * (a % 3)).alias("lon2"), (0.001 * (1 + a % 3)).alias("dlat"), (0.001 * (1 + a % 2)).alias("dlon"))
    return los.common_area(ext).select(*[R(c(n), 6).alias(n) for n in ("north", "south", "west", "east", "dlat", "dlon")], "n_sides")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity map referenced to an area."""
    return QUERIES["qry03_velocity_map"](spark, sf_dir)


