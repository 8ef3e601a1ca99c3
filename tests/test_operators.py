"""Hand-sized fixtures and properties of the engine's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantstack.functions import scalar as S
from slantstack.model import Box, Grid, Sensor, Thresholds, parse_geo_range, parse_line, parse_point, parse_range
from slantstack.operators import closure, correct, decide, detrend, invert, los, network, raster, series, smooth


def cube(spark, values, years=None):
    """{(y, x): series} to cum rows."""
    rows = [(y, x, t, float(t if years is None else years[t]), None if v is None else float(v)) for (y, x), d in values.items() for t, v in enumerate(d)]
    return spark.createDataFrame(rows, "y int, x int, t int, yr double, d double")


def image(spark, a, names="v"):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(a) for x, v in enumerate(r)], f"y int, x int, {names} double")


def grid_of(df, value):
    return {(r["y"], r["x"]): r[value] for r in df.collect()}


def pairs_of(spark, ij):
    return spark.createDataFrame([(p, i, j) for p, (i, j) in enumerate(ij)], "p int, i int, j int")


def test_block_means_half_full(spark):
    a = [[1, None, 3, 4], [2, None, 5, 6], [None, None, 1, 1], [None, 7, 1, 1]]
    got = grid_of(raster.block_means(image(spark, a), 2, 2, Grid(4, 4)), "v")
    assert got == {(0, 0): 1.5, (0, 1): 4.5, (1, 0): None, (1, 1): 1.0}


def test_block_means_drop_edges(spark):
    got = grid_of(raster.block_means(image(spark, [[1] * 5] * 5), 2, 2, Grid(5, 5)), "v")
    assert got == {(y, x): 1.0 for y in (0, 1) for x in (0, 1)}


@pytest.mark.parametrize("text,want", [("0:0/0:0", Box(0, 10, 0, 8)), ("2:5/1:3", Box(2, 5, 1, 3))])
def test_ranges(text, want):
    assert parse_range(text, 10, 8) == want


@pytest.mark.parametrize("text", ["5:2/0:0", "0:11/0:0", "x", "2:2/0:0"])
def test_bad_ranges(text):
    with pytest.raises(ValueError):
        parse_range(text, 10, 8)


def test_geo_forms():
    g = Grid()
    assert parse_geo_range("14.02/14.05/40.95/40.98", g) == Box(2, 6, 2, 6)
    assert parse_geo_range("13/15/40/42", g) == Box(0, 10, 0, 10)
    assert parse_line("0,0/3,0", 10, 10) == (0, 0, 3, 0)
    assert parse_point("3/4", 10, 10) == (3, 4)
    with pytest.raises(ValueError):
        parse_point("10/4", 10, 10)
    with pytest.raises(ValueError):
        parse_geo_range("20/21/40/41", g)
    assert Sensor().band == "C" and Sensor(1.27e9).band == "L"


def test_triangles(spark):
    p = pairs_of(spark, [(0, 1), (0, 2), (1, 2), (2, 3)])
    loops = network.triangles(p)
    assert [tuple(r) for r in loops.select("p12", "p23", "p13").collect()] == [(0, 2, 1)]
    assert [r["p"] for r in network.without_loop(p, loops).collect()] == [3]


def packed(spark, ph, n):
    rows = [(y, x, p, None if v is None else float(v), 0.5) for (y, x), d in ph.items() for p, v in enumerate(d)]
    return closure.pack(spark.createDataFrame(rows, "y int, x int, p int, ph double, coh double"), n)


def test_whole_cycles_leave(spark):
    p = pairs_of(spark, [(0, 1), (0, 2), (1, 2)])
    loops = network.triangles(p)
    k = packed(spark, {(0, x): [1.0, 3 - 2 * math.pi, 2.0] for x in range(3)}, 3)
    rated = closure.loop_rms(closure.without_cycles(closure.loop_phase(k, loops)), loops).collect()
    assert len(rated) == 1 and rated[0]["rms"] < 1e-9


def test_no_loops_at_all(spark):
    p = pairs_of(spark, [(0, 1), (1, 2)])
    loops = network.triangles(p)
    k = packed(spark, {(0, 0): [1.0, 2.0]}, 2)
    assert closure.loop_phase(k, loops).count() == 0
    assert closure.loop_rms(closure.loop_phase(k, loops), loops).count() == 0
    assert grid_of(closure.no_loop_counts(k, loops), "n_noloop") == {(0, 0): 2}


def test_gap_and_run(spark):
    p = pairs_of(spark, [(0, 1), (2, 3)])
    gap = closure.gap_flags(packed(spark, {(0, 0): [1.0, 1.0], (0, 1): [None, 1.0]}, 2), p, 4)
    assert grid_of(gap, "gap") == {(0, 0): [0, 1, 0], (0, 1): [1, 1, 0]}
    assert grid_of(closure.gap_counts(gap), "n_gap") == {(0, 0): 1, (0, 1): 2}
    g = spark.createDataFrame([(0, 0, [0, 1, 0, 0])], "y int, x int, gap array<int>")
    assert grid_of(closure.longest_run(g, [0.0, 1, 2, 3, 4]), "max_run") == {(0, 0): 2.0}


def test_bad_pairs_are_in_no_good_loop(spark):
    rated = spark.createDataFrame([(0, 0, 1, 2, 0.1), (1, 2, 3, 4, 1.5), (2, 5, 3, 0, float("inf"))], "l int, p12 int, p23 int, p13 int, rms double")
    assert sorted(r["p"] for r in closure.bad_pairs(rated, 1.5).collect()) == [3, 4, 5]


NET = [(i, j) for i in range(6) for j in range(i + 1, min(6, i + 4))]


def test_inversion_recovers_series(spark):
    rng = np.random.default_rng(3)
    truth = {(0, x): np.concatenate(([0.0], rng.normal(size=5).cumsum())) for x in range(4)}
    ph = {k: [d[j] - d[i] for i, j in NET] for k, d in truth.items()}
    ph[(0, 3)][0] = None
    years = [0.2 * t for t in range(6)]
    inv = invert.invert(packed(spark, ph, len(NET)), pairs_of(spark, NET), years)
    got = grid_of(invert.accumulate(inv), "d")
    for k, d in truth.items():
        assert np.allclose(got[k], d, atol=1e-5)
    assert all(v < 1e-5 for v in grid_of(inv, "resid_rms").values())
    w = grid_of(invert.accumulate(invert.invert(packed(spark, ph, len(NET)), pairs_of(spark, NET), years, weighted=True)), "d")
    assert all(np.allclose(w[k], d, atol=1e-4) for k, d in truth.items())


def test_inversion_equals_lstsq(spark):
    """Patterns share a pseudo-inverse; the result is each pixel's own least squares."""
    rng = np.random.default_rng(5)
    ph = {(0, x): [None if rng.random() < 0.3 else v for v in rng.normal(size=len(NET))] for x in range(20)}
    years = [0.2 * t for t in range(6)]
    got = grid_of(invert.invert(packed(spark, ph, len(NET)), pairs_of(spark, NET), years), "inc")
    a = invert.design(NET, years, 1e-4)
    for k, d in ph.items():
        ok = [v is not None for v in d]
        rows = np.concatenate((a[: len(NET)][ok], a[len(NET) :]))
        want = np.linalg.lstsq(rows, np.concatenate(([v for v in d if v is not None], np.zeros(6))), rcond=None)[0]
        assert np.allclose(got[k], want[:5], atol=1e-6)


def test_weighted_inversion_equals_lstsq():
    """Pixels of a pattern are solved together, in stacks; the result is each pixel's own weighted least squares."""
    rng = np.random.default_rng(6)
    d, var = rng.normal(size=(600, len(NET))), rng.uniform(0.01, 5, (600, len(NET)))
    d[rng.random(600) < 0.5, 2] = np.nan
    d[rng.random(d.shape) < 0.02] = np.nan
    d[5], var[7, 0], d[7, 0] = np.nan, np.nan, 1.0
    a = invert.design(NET, [0.2 * t for t in range(6)], 1e-4)
    got, m = invert.solve_weighted(d, var, a), len(NET)
    for k in range(600):
        ok = ~np.isnan(d[k])
        if k in (5, 7):
            assert np.isnan(got[k]).all()
            continue
        rows = np.concatenate((a[:m][ok] / np.sqrt(var[k][ok])[:, None], a[m:] / np.sqrt(invert.CONSTRAINT_VARIANCE)))
        want = np.linalg.lstsq(rows, np.concatenate((d[k][ok] / np.sqrt(var[k][ok]), np.zeros(6))), rcond=None)[0]
        assert np.allclose(got[k], want, rtol=1e-6, atol=1e-6)


def test_pixels_without_data(spark):
    k = packed(spark, {(0, 0): [None] * len(NET), (0, 1): [1.0] * len(NET)}, len(NET))
    inv = invert.invert(k, pairs_of(spark, NET), [0.2 * t for t in range(6)])
    assert grid_of(inv, "vel")[(0, 0)] is None
    assert invert.invert(k, pairs_of(spark, NET), [0.2 * t for t in range(6)], min_ratio=1.0).count() == 1


@pytest.mark.parametrize("gap,null", [([0, 1, 1, 0], [2]), ([0, 0, 0, 1], [4]), ([0, 0, 0, 0], [])])
def test_gap_nulls(spark, gap, null):
    inv = spark.createDataFrame([(0, 0, [1.0] * 4)], "y int, x int, inc array<double>")
    g = spark.createDataFrame([(0, 0, gap)], "y int, x int, gap array<int>")
    d = invert.accumulate(inv, g).first()["d"]
    assert [t for t, v in enumerate(d) if v is None] == null and d[0] == 0


def test_velocity_and_wave(spark):
    v = series.velocity(cube(spark, {(0, 0): [3 * t - 1 for t in range(5)], (0, 1): [None, 2.0, None, None, None]})).collect()
    got = {(r["y"], r["x"]): (r["vel"], r["vintercept"]) for r in v}
    assert np.allclose(got[(0, 0)], (3, -1)) and got[(0, 1)] == (None, None)
    years = [t / 12 for t in range(36)]
    w = series.annual(cube(spark, {(0, 0): [2 * math.sin(2 * math.pi * t) for t in years]}, years)).first()
    assert abs(w["amplitude"] - 2) < 1e-6 and min(w["peak_day"], 365.25 - w["peak_day"]) < 1e-3 and abs(w["vel"]) < 1e-6


def test_bootstrap_against_numpy(spark):
    years, rng = [0.1 * t for t in range(12)], np.random.default_rng(1)
    d = rng.normal(size=12)
    draws = series.draw(12, 50)
    slopes = []
    for b in range(50):
        t = [k for bb, k in draws if bb == b]
        if len(set(t)) > 1:
            slopes.append(np.polyfit(np.array(years)[t], d[t], 1)[0])
    got = series.velocity_std(cube(spark, {(0, 0): list(d)}, years), 12, 50).first()["vstd"]
    assert abs(got - np.std(slopes)) < 1e-8


def test_neighbour_consistency(spark):
    rows = [(0, 0, [0.0, 1.0, 2.0]), (0, 1, [0.0, 1.0, 2.0]), (0, 2, [0.0, 3.0, 2.0]), (5, 5, [0.0, 1.0, 2.0])]
    got = grid_of(series.consistency(spark.createDataFrame(rows, "y int, x int, d array<double>")), "stc")
    want = math.sqrt((4 + 4) / 2)
    assert got[(0, 0)] is None and abs(got[(0, 1)] - want) < 1e-9 and abs(got[(0, 2)] - want) < 1e-9 and got[(5, 5)] is None


def test_ramp_leaves_nothing(spark):
    values = {(y, x): [0.0, 1 + 2 * x + 3 * y] for y in range(4) for x in range(5)}
    c = cube(spark, values)
    mask = spark.createDataFrame([(y, x, int((y, x) not in {(0, 0), (1, 2), (3, 3)})) for y, x in values], "y int, x int, mask int")
    out = detrend.detrended(c, detrend.coefficients(c, "1", mask=mask), "1")
    assert all(abs(r["d"]) < 1e-8 for r in out.collect())


def test_height_outside_range_counts_as_zero(spark):
    c = cube(spark, {(0, x): [0.01 * h] for x, h in enumerate((100, 150, 300, 400))}).withColumn("hgt", F.element_at(F.array(*[F.lit(float(h)) for h in (100, 150, 300, 400)]), F.col("x") + 1))
    k = detrend.coefficients(c, None, (200.0, 1000.0)).first()
    want = np.linalg.lstsq(np.array([[1, 0], [1, 0], [1, 300], [1, 400.0]]), np.array([1, 1.5, 3, 4]), rcond=None)[0]
    assert np.allclose((k["b_one"], k["b_hgt"]), want)


@pytest.mark.parametrize("ramp", ["bl", "2"])
def test_higher_ramps_against_lstsq(spark, ramp):
    rng = np.random.default_rng(2)
    values = {(y, x): [float(rng.normal())] for y in range(6) for x in range(6)}
    k = detrend.coefficients(cube(spark, values), ramp).first()
    terms = {"one": lambda y, x: 1, "x": lambda y, x: x, "y": lambda y, x: y, "xy": lambda y, x: x * y, "xx": lambda y, x: x * x, "yy": lambda y, x: y * y}
    a = np.array([[terms[n](y, x) for n in detrend.RAMPS[ramp]] for y, x in values], float)
    want = np.linalg.lstsq(a, np.array([v[0] for v in values.values()]), rcond=None)[0]
    assert np.allclose([k[f"b_{n}"] for n in detrend.RAMPS[ramp]], want, atol=1e-6)


def test_thresholds_keep_equality(spark):
    limits = Thresholds(coh_avg=0.05, n_unw=4, max_run=1, vstd=2, n_gap=3, stc=5, n_noloop=6, n_loop_err=7, resid_rms=8)
    names = ", ".join(f"{n} double" for n in decide.CRITERIA)
    at = [float(getattr(limits, n)) for n in decide.CRITERIA]
    rows = [(0, 0, 1.0, *at)] + [(1, k, 1.0, *[v + (-0.01 if n in decide.FLOORS else 0.01) if m == k else v for m, (n, v) in enumerate(zip(decide.CRITERIA, at, strict=True))]) for k in range(9)] + [(2, 0, 1.0, None, *at[1:]), (3, 0, None, *at)]
    got = grid_of(decide.mask_board(spark.createDataFrame(rows, f"y int, x int, vel double, {names}"), limits), "mask")
    assert got[(0, 0)] == 1 and all(got[(1, k)] == 0 for k in range(9)) and got[(2, 0)] == 0 and got[(3, 0)] is None


def test_threshold_adjustment(spark):
    stats = spark.createDataFrame([(0.2, 12.4), (0.3, 15.0)], "coh_avg double, vstd double")
    limits, changed = decide.adjusted(stats, Thresholds(coh_avg=0.5, vstd=10.0))
    assert changed == ["coh_avg", "vstd"] and limits.vstd == 13.0 and limits.coh_avg == 0.0


def test_all_pairs_bad(spark):
    q = spark.createDataFrame([(0, 0.1, 0.5), (1, None, 0.5), (2, 0.9, None)], "p int, coverage double, coherence double")
    with pytest.raises(ValueError):
        decide.require_good(decide.bad_pairs(q))
    q = spark.createDataFrame([(0, 0.3, 0.05), (1, 0.29, 0.5)], "p int, coverage double, coherence double")
    assert [r["bad"] for r in decide.bad_pairs(q).orderBy("p").collect()] == [False, True]


def test_looks(spark):
    rows = []
    for g, e, n in (("a", 0.6, -0.1), ("b", -0.6, -0.1)):
        u = math.sqrt(1 - e * e - n * n)
        rows.append((g, 0, 0, e, n, u, 5 * e - 2 * u))
    rows.append(("a", 0, 1, 0.6, -0.1, 0.79, 1.0))
    df = spark.createDataFrame(rows, "geom string, y int, x int, e double, n double, u double, disp double")
    got = {(r["y"], r["x"]): (r["ew"], r["ud"]) for r in los.decompose(df).collect()}
    assert np.allclose(got[(0, 0)], (5, -2)) and got[(0, 1)] == (None, None)
    with pytest.raises(ValueError):
        los.require_sides(df.where("e > 0"))


def test_profile_rounds_to_even(spark):
    got = raster.profile(image(spark, [[10, 20, 30, 40]]), (0, 0, 3, 0), Grid(4, 1)).orderBy("s").collect()
    assert [r["x"] for r in got] == [0, 2, 3] and [r["v"] for r in got] == [10, 30, 40]


def test_points_outside(spark):
    pts = spark.createDataFrame([(1, 41.0, 14.0), (2, 50.0, 14.0)], "pid int, lat double, lon double")
    got = {r["pid"]: (r["value"], r["mean"]) for r in raster.values_at(pts, image(spark, [[1, 2], [3, 4]]), Grid(2, 2)).collect()}
    assert got == {1: (1.0, 2.5), 2: (None, None)}


def test_smoothing_of_constants(spark):
    a = [[7.0 if (x + y) % 3 else None for x in range(6)] for y in range(6)]
    got = grid_of(smooth.spatial(image(spark, a), 1.0, 1.5), "lp")
    assert all(abs(v - 7) < 1e-9 for v in got.values()) and len(got) == 36
    years = [0.1 * t for t in range(9)]
    e = spark.createDataFrame(list(enumerate(years)), "t int, yr double")
    hp = smooth.temporal(cube(spark, {(0, 0): [4.0] * 9}, years), e, 0.2)
    assert all(abs(r["hp"]) < 1e-9 for r in hp.collect())


def test_references_are_idempotent(spark):
    c = cube(spark, {(0, 0): [0.0, 1.0, 4.0], (0, 1): [0.0, 2.0, 3.0]})
    once = series.rereference(c, series.area_series(c, Box(0, 1, 0, 1)))
    twice = series.rereference(once, series.area_series(once, Box(0, 1, 0, 1)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    none = series.area_series(c.withColumn("d", F.lit(None).cast("double")), Box(0, 1, 0, 1))
    assert all(r["ref"] is None for r in none.collect())


def test_corrections(spark):
    p = pairs_of(spark, [(0, 1), (1, 2)])
    d = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 3.0)], "t int, y int, x int, delay double")
    assert [tuple(r) for r in correct.pair_corrections(p, d).collect()] == [(0, 0, 0, 2.0)]
    assert [r["p"] for r in correct.uncorrectable(p, d).collect()] == [1]


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 1.0), (float("nan"), 0.0), (2.0, None)], "v double, c double")
    got = df.select(S.clean(F.col("v")), S.variance(F.col("c"))).collect()
    assert [r[0] for r in got] == [None, None, 2.0]
    assert abs(got[0][1] - (1 - 0.99**2) / (2 * 0.99**2)) < 1e-12 and abs(got[1][1] - (1 - 1e-4) / 2e-4) < 1e-6 and got[2][1] is None
    sizes = spark.createDataFrame([(0,), (5,), (2048,), (1_234_567,), (3 * 1024**3,), (1024**6 + 1024**5 // 8,)], "n long").select(S.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0B", "5.0B", "2.0KB", "1.18MB", "3.0GB", "1.0EB"]


def test_empty_inputs(spark):
    c = cube(spark, {(0, 0): [1.0]}).limit(0)
    assert series.velocity(c).count() == 0 and series.spatial_rms(c, 3).count() == 0
    assert raster.block_means(image(spark, [[1]]).limit(0), 1, 1, Grid(1, 1)).count() == 0


def test_zoom_levels_have_their_upper_edges(spark):
    sizes = [1.0, 5.0, 5.1, 10.0, 20.0, 40.0, 80.0, 160.0, 160.1]
    got = spark.createDataFrame([(v,) for v in sizes], "m double").select(S.zoom_level(F.col("m"))).collect()
    assert [r[0] for r in got] == [17, 17, 16, 16, 15, 14, 13, 12, 11]


def test_default_thresholds():
    from slantstack.model import LIGHT_SPEED, default_thresholds

    assert default_thresholds(Sensor(), 43) == Thresholds(coh_avg=0.05, n_unw=64.0, max_run=1.0, vstd=100.0, n_gap=10.0, stc=5.0, n_noloop=50.0, n_loop_err=5.0, resid_rms=2.0)
    assert default_thresholds(Sensor(LIGHT_SPEED / 0.24), 43) == Thresholds(coh_avg=0.01, n_unw=43.0, max_run=1.0, vstd=200.0, n_gap=1.0, stc=10.0, n_noloop=50.0, n_loop_err=1.0, resid_rms=10.0)


def test_loop_flags_by_precedence(spark):
    pairs = pairs_of(spark, [(k, k + 1) for k in range(12)] + [(k, k + 2) for k in range(11)])
    loops = network.triangles(pairs)
    of = {r["l"]: {r["p12"], r["p23"], r["p13"]} for r in loops.collect()}
    ps = lambda *p: spark.createDataFrame([(x,) for x in p], "p int")
    lists = [{0}, {0, 2}, {2, 4}, {4, 6}, {6, 8}]
    got = {r["l"]: r["flag"] for r in closure.loop_flags(loops, *(ps(*x) for x in lists)).collect()}
    want = {l: next((m for m, x in zip(("*", "+", "**", "***", "/"), lists, strict=True) if x & p), "") for l, p in of.items()}
    assert got == want and set(want.values()) == {"*", "+", "**", "***", "/", ""}
