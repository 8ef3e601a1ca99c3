"""Per-pixel constrained least squares: pair observations to increments, and from these the displacement series.

Unknowns: n-1 increments, a velocity and a constant. To the observation rows come n rows gamma * (sum of increments -
velocity * t - constant) = 0, which tie disconnected parts of the network. A batch of pixels is grouped by which pairs have
data; each pattern needs one pseudo-inverse, used for all its pixels, so pixels with all pairs cost a product. Weighted
fits have rows divided by the standard deviation and are solved pixel by pixel.

Only this step leaves generated code (Arrow batches, numpy); it reads and writes packed rows, so nothing is shuffled.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variance of the constraint rows of a weighted fit.
CONSTRAINT_VARIANCE = 50.0
_KEPT_PATTERNS = 512
#: Weighted pixels factored at a time.
_STACKED = 256


def design(pairs: list[tuple[int, int]], years: list[float], gamma: float) -> np.ndarray:
    """(pairs + epochs) x (epochs + 1)."""
    n = len(years)
    a = np.zeros((len(pairs) + n, n + 1))
    for r, (i, j) in enumerate(pairs):
        a[r, i:j] = 1
    a[len(pairs) :, : n - 1] = np.tril(np.ones((n, n - 1)), -1) * gamma
    a[len(pairs) :, n - 1] = -gamma * np.asarray(years)
    a[len(pairs) :, n] = -gamma
    return a


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(values.ravel(), from_pandas=True))


def _patterns(have: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Key, pairs and rows of each pattern of data."""
    patterns, which = np.unique(np.packbits(have, axis=1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for bits, at in zip(patterns, np.split(order, np.cumsum(np.bincount(which.ravel(), minlength=len(patterns)))[:-1]), strict=True):
        yield bits.tobytes(), have[at[0]], at


def solve(d: np.ndarray, a: np.ndarray, cache: OrderedDict) -> np.ndarray:
    """Solutions of all rows of d (NaN: no data), one pseudo-inverse a pattern."""
    m = d.shape[1]
    out = np.full((len(d), a.shape[1]), np.nan)
    for key, rows, at in _patterns(~np.isnan(d)):
        if not rows.any():
            continue
        if key not in cache:
            cache[key] = np.linalg.pinv(np.concatenate((a[:m][rows], a[m:])), rcond=np.finfo(float).eps * max(a.shape))[:, : rows.sum()]
            if len(cache) > _KEPT_PATTERNS:
                cache.popitem(last=False)
        out[at] = d[at][:, rows] @ cache[key].T
    return out


def solve_weighted(d: np.ndarray, var: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Like ``solve``, each pixel with its own weights; a pixel whose data lack a variance is NaN.

    One pair with data and the constraint rows make the design's rank full, so QR needs no pivots.
    """
    m = d.shape[1]
    out = np.full((len(d), a.shape[1]), np.nan)
    tied = a[m:] / np.sqrt(CONSTRAINT_VARIANCE)
    have = ~np.isnan(d)
    sound = have.any(1) & ~(have & np.isnan(var)).any(1)
    for _, rows, every in _patterns(have):
        every = every[sound[every]]
        for i in range(0, len(every), _STACKED):
            at = every[i : i + _STACKED]
            w = 1 / np.sqrt(var[at][:, rows])
            q, r = np.linalg.qr(np.concatenate((a[:m][rows] * w[:, :, None], np.broadcast_to(tied, (len(at), *tied.shape))), axis=1))
            out[at] = np.linalg.solve(r, np.einsum("prk,pr->pk", q[:, : rows.sum()], d[at][:, rows] * w)[:, :, None])[:, :, 0]
    return out


def _inverter(pairs, years, gamma, weighted):
    m, n = len(pairs), len(years)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, cache = design(pairs, years, gamma), OrderedDict()
        for b in batches:
            if not b.num_rows:
                continue
            d = _doubles(b.column(2), m)
            x = solve_weighted(d, _doubles(b.column(3), m), a) if weighted else solve(d, a, cache)
            with np.errstate(invalid="ignore"):
                resid = d - x @ a[:m].T
                have = ~np.isnan(resid)
                count = have.sum(1)
                rms = np.sqrt(np.divide(np.nansum(resid**2, axis=1), count, out=np.full(len(d), np.nan), where=count > 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(x[:, : n - 1]), _lists(np.cumsum(x[:, : n - 1], axis=1)), pa.array(x[:, n - 1], from_pandas=True), pa.array(x[:, n], from_pandas=True), _lists(resid), pa.array(rms, from_pandas=True)], names=["y", "x", "inc", "cum", "vel", "const", "resid", "resid_rms"])

    return invert


def invert(packed: DataFrame, pairs: DataFrame, years: list[float], *, gamma: float = 1e-4, coef: float = 1.0, min_ratio: float | None = None, weighted: bool = False) -> DataFrame:
    """y, x, inc (by increment), cum (sums of increments), vel, const, resid (by pair) and resid_rms of packed pixels.

    ``coef`` converts the phases (mm per radian). ``min_ratio``: pixels need more than int(ratio * epochs) pairs.
    ``weighted``: weights from coherence, clamped to [0.01, 0.99].
    """
    rows = packed.where(F.size(F.filter("ph", lambda v: v.isNotNull())) > int(min_ratio * len(years))) if min_ratio is not None else packed
    c = lambda v: F.greatest(F.lit(0.01), F.least(F.lit(0.99), v))
    var = F.transform("coh", lambda v: F.when(v.isNotNull(), (1 - c(v) * c(v)) / (2 * c(v) * c(v))))
    read = rows.select("y", "x", F.transform("ph", lambda v: v * coef).alias("d"), *([var.alias("var")] if weighted else []))
    listed = [(r["i"], r["j"]) for r in pairs.orderBy("p").select("i", "j").collect()]
    return read.mapInArrow(_inverter(listed, years, gamma, weighted), "y int, x int, inc array<double>, cum array<double>, vel double, const double, resid array<double>, resid_rms double")


def accumulate(inverted: DataFrame, gap: DataFrame | None = None) -> DataFrame:
    """y, x, d: the series from the increments. Epoch 0 is 0 where epoch 1 has data; with ``gap`` an epoch between two
    gaps, and the last after a gap, are NULL. Rows without the worker's sums (``cum``) are summed here."""
    d = F.col("cum") if "cum" in inverted.columns else F.aggregate("inc", F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + v)))
    rows = inverted.select("y", "x", d.alias("d"))
    if gap is not None:
        rows = rows.join(gap, ["y", "x"]).select("y", "x", F.transform("d", lambda v, k: F.when((F.get("gap", k) == 0) | (F.coalesce(F.get("gap", k + 1), F.lit(1)) == 0), v)).alias("d"))
    return rows.select("y", "x", F.concat(F.array(F.when(F.get("d", F.lit(0)).isNotNull(), F.lit(0.0))), F.col("d")).alias("d"))


def long_series(packed_series: DataFrame, years: list[float]) -> DataFrame:
    """y, x, t, yr, d."""
    yr = F.array(*[F.lit(v) for v in years])
    return packed_series.select("y", "x", F.posexplode("d").alias("t", "d")).select("y", "x", "t", F.get(yr, F.col("t")).alias("yr"), "d")


def pair_rms(inverted: DataFrame) -> DataFrame:
    """p, n, rms of the residuals of each pair."""
    return inverted.select(F.posexplode("resid").alias("p", "r")).groupBy("p").agg(F.count("r").alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))
