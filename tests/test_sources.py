"""Round trips of sources and sinks, incremental runs, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantstack.model import Box, Grid, Sensor, Settings, Thresholds
from slantstack.plans.pipeline import Pipeline, Run, check_loops, with_overrides
from slantstack.plans.stack import COEF, Stack
from slantstack.sources import export, flat, texts
from slantstack.streaming import ingest


def test_flat_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(7, 5)).astype("<f4")
    a[2, 3] = 0
    a.tofile(tmp_path / "one.flat")
    np.arange(35, dtype=np.uint8).tofile(tmp_path / "two.flat")
    flat.register(spark)
    df = spark.read.format("flatraster").option("width", 5).option("length", 7).option("rows_per_task", 3).load(str(tmp_path))
    rows = {(r["name"], r["y"], r["x"]): r["v"] for r in df.collect()}
    assert len(rows) == 70 and rows[("one", 2, 3)] is None and abs(rows[("one", 6, 4)] - a[6, 4]) < 1e-7 and abs(rows[("two", 1, 0)] - 5 / 255) < 1e-12
    other, skipped = flat.read_binary(spark, str(tmp_path), 5, 7)
    assert sorted(map(str, other.collect())) == sorted(map(str, df.collect())) and skipped.count() == 0
    flat.write_flat(df.where("name = 'one'"), str(tmp_path / "out"), 5, 7)
    assert np.array_equal(np.fromfile(tmp_path / "out/one.flat", "<f4").reshape(7, 5), a)
    with pytest.raises(ValueError):
        flat.kind_of(11, 35)
    big = a.astype(">f4").tobytes()
    assert np.allclose(flat.decode(big, "float32", "big")[0], a[0, 0])


def test_baselines(spark, tmp_path):
    e = spark.createDataFrame([(0, "2016-01-01"), (1, "2016-02-01"), (2, "2016-03-01")], "t int, d string").withColumn("d", F.to_date("d"))
    (tmp_path / "new").write_text("20160101 20160201 10.5 31\n20160101 20160301 -4.0 60\n")
    (tmp_path / "old").write_text("1 20160101 20160201 10.5 31 0 31 0.0 10.5\n2 20160201 20160301 -14.5 29 31 60 10.5 -4.0\n")
    want = {0: 0.0, 1: 10.5, 2: -4.0}
    for name in ("new", "old"):
        assert {r["t"]: r["bperp"] for r in texts.baselines(spark, str(tmp_path / name), e).collect()} == want
    (tmp_path / "short").write_text("20160101 20160201 10.5 31\n")
    with pytest.raises(ValueError):
        texts.baselines(spark, str(tmp_path / "short"), e)


def test_text_lists(spark, tmp_path):
    (tmp_path / "pairs").write_text("20160101_20160201\n# 20160101_20160301\n\n20160201_20160301 0.2\n")
    assert sorted(r["name"] for r in texts.pair_list(spark, str(tmp_path / "pairs")).collect()) == ["20160101_20160201", "20160201_20160301"]
    (tmp_path / "par").write_text("n_im_all: 30\nn_im: 28\nwidth: 10\nnlines: 8\ncorner_lat: 41\ncorner_lon: 14\npost_lat: -0.01\npost_lon: 0.01\nradar_frequency: 5405000454.3 Hz\n")
    par = str(tmp_path / "par")
    assert texts.parameter(spark, par, "n_im") == "28" and texts.parameter(spark, par, "none") is None
    assert texts.read_grid(spark, par).width == 10 and texts.read_sensor(spark, par).band == "C"
    (tmp_path / "ranges").write_text("2:5/1:3\n0:0/7:0\n")
    assert texts.ranges(spark, str(tmp_path / "ranges"), Grid(10, 8)) == [Box(2, 5, 1, 3), Box(0, 10, 7, 8)]
    (tmp_path / "points").write_text("41.0 14.0\nx y\n40.5 14.1\n")
    assert [(r["lat"], r["lon"]) for r in texts.points(spark, str(tmp_path / "points")).orderBy("pid").collect()] == [(41.0, 14.0), (40.5, 14.1)]
    (tmp_path / "looks").write_text("a b c\nd e f\n")
    assert texts.look_list(spark, str(tmp_path / "looks")).count() == 2


def test_series_text(spark, tmp_path):
    s = spark.createDataFrame([(0, "2016-01-01", 0.0, 0.0), (1, "2017-01-01", 1.0, 3.0), (2, "2018-01-01", 2.0, None)], "t int, day string, yr double, d double").withColumn("day", F.to_date("day"))
    export.write_lines(export.series_lines(s, 3, 4, Grid(), "0:1/0:1"), str(tmp_path / "ts"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "ts")).collect()]
    assert lines[-3:] == ["20160101 0.00", "20170101 3.00", "20180101 nan"] and "3.000*t+0.000" in lines[3]
    assert "14.03,40.96" in export.kml_point(40.96, 14.03) and "1,2 3,4" in export.kml_line([(2, 1), (4, 3)])
    f = spark.createDataFrame([(5, [[14.0, 41.0], [14.1, 41.1]])], "level int, coords array<array<double>>")
    assert export.geojson_features(f).first()[0].startswith('{"type":"Feature","properties":{"level":5}')


def test_row_blocks(spark, tmp_path):
    df = spark.range(600).select((F.col("id") / 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("x"))
    export.write_blocks(df, str(tmp_path / "b"), rows=64)
    assert export.read_blocks(spark, str(tmp_path / "b"), 60, 70, rows=64).count() == 20
    assert export.layer_or_none(spark, str(tmp_path), "absent") is None


def test_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    make = lambda n, v: spark.createDataFrame([(n, 0, 0, v), (n, 0, 1, 0.0)], flat.SCHEMA).write.mode("append").parquet(src)
    make("a", 1.0)
    assert ingest.ingest(spark, src, flat.SCHEMA, out, ck, ingest.without_zero) == 2
    make("b", 2.0)
    assert ingest.ingest(spark, src, flat.SCHEMA, out, ck, ingest.without_zero) == 2
    assert ingest.ingest(spark, src, flat.SCHEMA, out, ck, ingest.without_zero) == 0
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.where("v is null").count() == 2
    wanted = spark.createDataFrame([("a",), ("c",)], "name string")
    assert [r["name"] for r in ingest.pending(wanted, got).collect()] == ["c"]


def test_pipeline(spark, tmp_path):
    st = Stack(spark, "/root/testdata/sf0.01")
    tables = {n: getattr(st, n) for n in ("epochs", "pairs", "obs")}
    for n, df in tables.items():
        df.write.parquet(str(tmp_path / n))
        tables[n] = spark.read.parquet(str(tmp_path / n))
    sensor = Sensor()
    assert abs(sensor.mm_per_radian - COEF) < 1e-3
    limits = Thresholds(n_unw=10, vstd=1e6, n_gap=1e6, stc=1e6, n_noloop=1e6, n_loop_err=1e6, resid_rms=1e6)
    run = Run(tables, st.grid, sensor, str(tmp_path / "run"), Settings(bootstrap=10, thresholds=limits), boxes=[Box(0, 1, 0, 1)])
    p = Pipeline(order=("mask",))
    assert p.plan() == ["mask", "check_pairs", "check_loops", "inversion", "uncertainty", "masking", "filtering"]
    assert Pipeline(start=11, end=12, order=("clip",)).plan() == ["check_pairs", "check_loops"]
    with pytest.raises(ValueError):
        Pipeline(order=("x",)).plan()
    p.run(run)
    assert run.tables["velocity"].count() >= 99 and run.notes["ref"]
    assert export.layer_or_none(spark, f"{run.folder}/store", "velocity").count() == run.tables["velocity"].count()
    s = with_overrides(Settings(), {"loop_rms": "2.5", "gamma": ""})
    assert s.loop_rms == 2.5 and s.gamma == 1e-4
    with pytest.raises(ValueError):
        with_overrides(Settings(), {"none": "1"})


def test_only_the_third_pass_removes_a_pair(spark, tmp_path):
    """Pair 3 is a cycle off everywhere but at the reference, which a median can't tell: only the pass against the reference can."""
    pairs = [(0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (3, 4)]
    rows = []
    for x in range(40):
        for p, (i, j) in enumerate(pairs):
            at_ref = x == 7
            ph = 0.1 * (j - i) + 0.01 * ((x + p) % 3) + (6.283185307179586 if p == 3 and not at_ref else 0.0)
            rows.append((0, x, p, ph if p < 5 or at_ref else None, 0.5))
    tables = {"epochs": spark.createDataFrame([(t, 0.1 * t) for t in range(5)], "t int, yr double"), "pairs": spark.createDataFrame([(p, i, j) for p, (i, j) in enumerate(pairs)], "p int, i int, j int"), "obs": spark.createDataFrame(rows, "y int, x int, p int, ph double, coh double"), "bad": spark.createDataFrame([], "p int")}
    run = Run(tables, Grid(40, 1), Sensor(), str(tmp_path / "run"))
    check_loops(run)
    assert run.notes["ref"] == "7:8/0:1"
    assert {r["p"] for r in run.tables["bad_pairs"].collect()} == {0, 3}
    assert {r["flag"] for r in run.tables["loop_flags"].collect()} == {"***", "/"}  # pair 1 of the bad loop remains a candidate
    removed = Run(tables | {"removed": spark.createDataFrame([(4,)], "p int")}, Grid(40, 1), Sensor(), str(tmp_path / "again"))
    check_loops(removed)
    assert {r["p"] for r in removed.tables["bad_pairs"].collect()} == {0, 1, 3, 4}
