"""Column expressions; all stay in generated code."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantstack.model import Box, Grid, Sensor


def rounded(c: Column, digits: int) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clean(c: Column) -> Column:
    """0 and NaN mean no data."""
    return F.nullif(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def to_mm(phase: Column, sensor: Sensor) -> Column:
    return phase * sensor.mm_per_radian


def delay_to_phase(metres: Column, los_up: Column, sensor: Sensor) -> Column:
    """Zenith delay in metres to slant-range radians."""
    return F.try_divide(metres, los_up) * (4 * math.pi / sensor.wavelength)


def wrapped(phase: Column, cycles: float) -> Column:
    """Phase over ``cycles`` wrapped to (-pi, pi]."""
    return F.atan2(F.sin(phase / cycles), F.cos(phase / cycles))


def variance(coh: Column) -> Column:
    """Phase variance of a coherence, which is clamped to [0.01, 0.99]."""
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), coh))
    return F.when(coh.isNotNull(), (1 - c * c) / (2 * c * c))


def year_fraction(day: Column, first: Column) -> Column:
    return F.date_diff(day, first) / F.lit(365.25)


def pixel_x(lon: Column, grid: Grid) -> Column:
    """Nearest column, ties to even."""
    return F.rint((lon - grid.corner_lon) / grid.post_lon).cast("int")


def pixel_y(lat: Column, grid: Grid) -> Column:
    return F.rint((lat - grid.corner_lat) / grid.post_lat).cast("int")


def longitude(x: Column, grid: Grid) -> Column:
    return grid.corner_lon + x * grid.post_lon


def latitude(y: Column, grid: Grid) -> Column:
    return grid.corner_lat + y * grid.post_lat


def incidence(los_up: Column) -> Column:
    return F.degrees(F.acos(los_up))


def log_intensity(v: Column) -> Column:
    return F.log10(F.nullif(v, F.lit(0.0)))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that keeps them at 1 or more, to two decimals at most; 0 is "0B"."""
    out = None
    for k in reversed(range(len(SIZE_UNITS))):
        text = F.concat(F.bround(n / F.lit(1024.0**k), 2).cast("string"), F.lit(SIZE_UNITS[k]))
        out = text if out is None else F.when(n < 1024.0 ** (k + 1), text).otherwise(out)
    return F.when(n == 0, "0B").otherwise(out)


#: Units of 1024 bytes.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
#: Zoom level and the largest pixel size in metres it is for, finest first; coarser pixels have COARSEST_ZOOM.
ZOOMS = [(17, 5.0), (16, 10.0), (15, 20.0), (14, 40.0), (13, 80.0), (12, 160.0)]
COARSEST_ZOOM = 11


def zoom_level(pixel_m: Column) -> Column:
    """Most detailed tile level that a pixel size is worth."""
    out = F.lit(COARSEST_ZOOM)
    for level, size in reversed(ZOOMS):
        out = F.when(pixel_m <= size, level).otherwise(out)
    return out


def flipped_tile_row(y: Column, zoom: Column) -> Column:
    """Row of the same tile counted from the other edge."""
    return F.pow(F.lit(2), zoom).cast("int") - y - 1


def colour_index(v: Column, low: float, high: float, levels: int) -> Column:
    """Level 0..levels-1 between two values; outside, the nearest."""
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor((v - low) / (high - low) * levels))).cast("int")


def inside(box: Box) -> Column:
    return (F.col("x") >= box.x1) & (F.col("x") < box.x2) & (F.col("y") >= box.y1) & (F.col("y") < box.y2)


def quantised(coh: Column) -> Column:
    """Coherence as 0..255, no data as 0."""
    return F.coalesce(F.floor(coh * 255), F.lit(0)).cast("int")


def los_up(e: Column, n: Column) -> Column:
    """Third component of a unit vector; NULL where nothing is left for it."""
    return F.nullif(F.sqrt(F.greatest(F.lit(0.0), 1 - n * n - e * e)), F.lit(0.0))


def primary_date(name: Column) -> Column:
    return F.to_date(F.substring(name, 1, 8), "yyyyMMdd")


def secondary_date(name: Column) -> Column:
    return F.to_date(F.substring(name, -8, 8), "yyyyMMdd")


def track(frame: Column) -> Column:
    """Number of a frame like 124D_04854_171313."""
    return F.nullif(F.regexp_extract(frame, r"(\d{3})[AD]_\d{5}_\d{6}", 1), F.lit("")).cast("int")


def frame_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{3}[AD]_\d{5}_\d{6})", 1), F.lit(""))


def with_parameter(text: Column, key: str, old: str, new: str) -> Column:
    """A parameter file's text with ``key: old`` as ``key: new``. What follows the old value stays: decimals, units."""
    return F.regexp_replace(text, re.escape(key) + r":\s*" + re.escape(old), f"{key}: {new}".replace("\\", "\\\\").replace("$", "\\$"))


def range_ends(text: Column) -> Column:
    """x1, x2, y1, y2 of ``x1:x2/y1:y2``, a string or its UTF-8 bytes."""
    parts = F.split(text.cast("string"), "[:/]")
    return F.struct(*[F.get(parts, F.lit(k)).cast("int").alias(n) for k, n in enumerate(("x1", "x2", "y1", "y2"))])


def output_name(name: Column, kind: str) -> Column:
    """Name of a result beside the velocity's: ``vel`` becomes the kind (vstd, amp, dt)."""
    return F.replace(name, F.lit("vel"), F.lit(kind))
