"""The processing steps as one object: start, end, order of optional steps, a dry run, and settings merged from overrides.

Tables go in and come out in a dict; a step reads what earlier ones put there. Results that several later steps read (pair
decisions, the series) are written to the run's folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantstack.model import Box, Grid, Sensor, Settings, default_thresholds
from slantstack.operators import closure, decide, detrend, invert, network, raster, series, smooth
from slantstack.sources import export


@dataclass
class Run:
    """What steps share. tables: epochs (t, yr), pairs (p, i, j), obs (y, x, p, ph, coh), optionally removed (p: pairs on the
    list of manual removal), and results by name."""

    tables: dict[str, DataFrame]
    grid: Grid
    sensor: Sensor
    folder: str
    settings: Settings = field(default_factory=Settings)
    boxes: list[Box] = field(default_factory=list)
    clip: Box | None = None
    notes: dict[str, str] = field(default_factory=dict)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.tables[name] = df.sparkSession.read.parquet(f"{self.folder}/{name}")
        return self.tables[name]

    @property
    def years(self) -> list[float]:
        return [r["yr"] for r in self.tables["epochs"].orderBy("t").collect()]


def mask(run: Run) -> None:
    run.tables["obs"] = raster.mask_box(run.tables["obs"], run.boxes, "ph")


def clip(run: Run) -> None:
    if run.clip:
        run.tables["obs"] = raster.clip(run.tables["obs"], run.clip)
        run.grid = run.grid.clipped(run.clip)


def check_pairs(run: Run) -> None:
    packed = closure.pack(run.tables["obs"], run.tables["pairs"].agg(F.max("p")).first()[0] + 1)
    quality = decide.pair_quality(packed, run.tables["pairs"], run.tables["epochs"].count())
    decided = decide.require_good(run.keep("quality", decide.bad_pairs(quality, run.settings.unw_ratio, run.settings.coherence)))
    run.tables["bad"] = decided.where("bad").select("p")


def check_loops(run: Run) -> None:
    """Pass 1 rates all loops; pass 2 picks the reference without bad and removed pairs; pass 3 rates what is left against
    the reference; pass 4 counts the loop errors of the pairs that stay."""
    t, limit = run.tables, run.settings.loop_rms
    removed = t["removed"].select("p") if "removed" in t else t["bad"].limit(0)
    pairs = network.minus(t["pairs"], t["bad"])
    loops = network.triangles(pairs)
    packed = closure.pack(t["obs"], 1 + t["pairs"].agg(F.max("p")).first()[0])
    phases = closure.without_cycles(closure.loop_phase(packed, loops))
    rated = run.keep("loops", closure.loop_rms(phases, loops))
    bad1 = closure.bad_pairs(rated, limit)
    good = network.minus(pairs, network.merged(bad1, removed))
    kept = network.triangles(good)
    phases = closure.without_cycles(closure.loop_phase(packed, kept))
    counts = run.keep("counts", closure.unwrap_counts(t["obs"].join(F.broadcast(good.select("p")), "p")))
    ref = run.keep("ref", closure.reference_pixel(closure.pixel_stats(phases), counts)).first()
    if ref is None:
        raise ValueError("no pixel is in any loop: there is no reference")
    box = Box(ref["x"], ref["x"] + 1, ref["y"], ref["y"] + 1)
    run.notes["ref"] = str(box)
    phase = closure.reference_phase(t["obs"], box)
    noref = network.minus(closure.pairs_without_reference(phase), t["bad"])
    third = run.keep("referenced_loops", closure.referenced_loop_rms(closure.loop_phase(packed, kept), phase, kept))
    bad3 = closure.bad_pairs(third, limit)
    bad = run.keep("bad_pairs", network.merged(t["bad"], bad1, removed, noref, bad3))
    run.keep("loop_flags", closure.loop_flags(loops, bad1, removed, noref, bad3, closure.remaining_candidates(third, bad, limit)))
    last = network.triangles(run.keep("good_pairs", network.minus(pairs, bad)))
    run.keep("loop_errors", closure.loop_errors(closure.loop_phase(packed, last), phase, last))


def inversion(run: Run) -> None:
    t = run.tables
    pairs = network.minus(t["pairs"], t["pairs"].join(t["good_pairs"], "p", "left_anti"))
    order = pairs.select("p", "i", "j").orderBy("i", "j").withColumn("k", F.row_number().over(_by("i", "j")) - 1)
    obs = t["obs"].join(F.broadcast(order.select("p", "k")), "p").drop("p").withColumnRenamed("k", "p")
    numbered = order.select(F.col("k").alias("p"), "i", "j")
    packed = run.keep("packed", closure.pack(obs, numbered.count()))
    inv = run.keep("inverted", invert.invert(packed, numbered, run.years, gamma=run.settings.gamma, coef=run.sensor.mm_per_radian))
    gap = run.keep("gap", closure.gap_flags(packed, numbered, len(run.years)))
    cum = invert.long_series(invert.accumulate(inv, gap), run.years)
    stable = series.stable_pixel(series.spatial_rms(cum, len(run.years)), closure.gap_counts(gap))
    run.keep("cum", series.rereference(cum, series.at_pixel(cum, stable)))
    run.tables["noloop"] = closure.no_loop_counts(packed, network.triangles(numbered))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


def uncertainty(run: Run) -> None:
    cum, n = run.tables["cum"], len(run.years)
    run.tables["vstd"] = series.velocity_std(cum, n, run.settings.bootstrap)
    run.tables["stc"] = series.consistency(series.pack_series(cum, n))


def masking(run: Run) -> None:
    t = run.tables
    stats = series.velocity(t["cum"])
    for df in (raster.coherence_mean(t["obs"]), t["counts"], closure.gap_counts(t["gap"]), closure.longest_run(t["gap"], run.years), t["noloop"], t["loop_errors"], t["inverted"].select("y", "x", "resid_rms"), t["vstd"], t["stc"]):
        stats = stats.join(df, ["y", "x"], "left")
    stats = run.keep("stats", stats)
    limits, changed = decide.adjusted(stats, run.settings.thresholds or default_thresholds(run.sensor, len(run.years)))
    run.notes["adjusted"] = ",".join(changed)
    run.keep("board", decide.mask_board(stats, limits))


def filtering(run: Run) -> None:
    t, s = run.tables, run.settings
    mask_ = t["board"].select("y", "x", "mask")
    flat = run.keep("flat", detrend.detrended(t["cum"], detrend.coefficients(t["cum"], "1", mask=mask_), "1").drop("trend"))
    north, east = run.grid.spacing_m()
    run.keep("cum_filtered", smooth.filtered(flat, t["epochs"], s.smooth_years or smooth.default_width(t["epochs"]), s.smooth_km * 1000 / north, s.smooth_km * 1000 / east))
    run.keep("velocity", decide.apply_mask(series.velocity(t["cum_filtered"]), t["board"]))
    export.write_stack(f"{run.folder}/store", t["cum_filtered"], run.notes, {"velocity": t["velocity"]})


#: Number, name, what is done, and whether it may be left out.
STEPS: list[tuple[int, str, Callable[[Run], None], bool]] = [
    (4, "mask", mask, True),
    (5, "clip", clip, True),
    (11, "check_pairs", check_pairs, False),
    (12, "check_loops", check_loops, False),
    (13, "inversion", inversion, False),
    (14, "uncertainty", uncertainty, False),
    (15, "masking", masking, False),
    (16, "filtering", filtering, False),
]


@dataclass
class Pipeline:
    start: int = 4
    end: int = 16
    #: Optional steps in the order they are to run; None runs none.
    order: tuple[str, ...] = ()

    def plan(self) -> list[str]:
        """Names of the steps that would run: the dry run."""
        optional = [n for n in self.order]
        unknown = set(optional) - {n for _, n, _, o in STEPS if o}
        if unknown:
            raise ValueError(f"no optional steps: {sorted(unknown)}")
        numbers = {n: k for k, n, _, _ in STEPS}
        names = optional + [n for _, n, _, o in STEPS if not o]
        return [n for n in names if self.start <= numbers[n] <= self.end]

    def run(self, run: Run) -> Run:
        by = {n: f for _, n, f, _ in STEPS}
        for name in self.plan():
            by[name](run)
        return run


def with_overrides(settings: Settings, overrides: dict[str, str]) -> Settings:
    """Settings with some values replaced from text; blanks keep the default, unknown names are an error."""
    changed = {}
    for k, v in overrides.items():
        if not hasattr(settings, k):
            raise ValueError(f"no setting {k}")
        if v.strip():
            changed[k] = type(getattr(settings, k))(v)
    return replace(settings, **changed)
