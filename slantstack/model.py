"""Grid, sensor and default parameters of a displacement stack.

Canonical tables: ``epochs(t, d, yr)``, ``pairs(p, i, j)``, ``obs(y, x, p, i, j, ph, coh)``, ``packed(y, x, ph, coh)``
(arrays by pair number), ``cum(y, x, t, yr, d)``. No-data is NULL in all of them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

LIGHT_SPEED = 299_792_458.0


@dataclass(frozen=True)
class Grid:
    width: int = 10
    length: int = 10
    corner_lat: float = 41.0
    corner_lon: float = 14.0
    post_lat: float = -0.01
    post_lon: float = 0.01
    ra: float = 6378137.0
    recip_f: float = 298.2572236

    def spacing_m(self) -> tuple[float, float]:
        """(north, east) pixel spacing in metres: polar radius along meridians, equatorial radius at the central latitude."""
        return self.spacing_at(self.corner_lat + self.post_lat * self.length / 2)

    def spacing_at(self, lat: float) -> tuple[float, float]:
        """(north, east) pixel spacing in metres at a latitude."""
        rb = self.ra * (1 - 1 / self.recip_f)
        return 2 * math.pi * rb / 360 * abs(self.post_lat), 2 * math.pi * self.ra / 360 * self.post_lon * math.cos(math.radians(lat))

    def coarser(self, ny: int, nx: int) -> "Grid":
        """The grid of ny x nx block means; its corner is the centre of the first block."""
        return Grid(self.width // nx, self.length // ny, self.corner_lat + self.post_lat * (ny - 1) / 2, self.corner_lon + self.post_lon * (nx - 1) / 2, self.post_lat * ny, self.post_lon * nx, self.ra, self.recip_f)

    def clipped(self, box: "Box") -> "Grid":
        return Grid(box.x2 - box.x1, box.y2 - box.y1, self.corner_lat + self.post_lat * box.y1, self.corner_lon + self.post_lon * box.x1, self.post_lat, self.post_lon, self.ra, self.recip_f)


@dataclass(frozen=True)
class Box:
    """Half-open index box."""

    x1: int
    x2: int
    y1: int
    y2: int

    def __str__(self) -> str:
        return f"{self.x1}:{self.x2}/{self.y1}:{self.y2}"


def parse_range(text: str, width: int, length: int) -> Box:
    """``x1:x2/y1:y2``; an upper bound of 0 means the full size."""
    m = re.fullmatch(r"\s*(\d+):(\d+)/(\d+):(\d+)\s*", text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    x1, x2, y1, y2 = map(int, m.groups())
    x2, y2 = x2 or width, y2 or length
    if x1 >= x2 or y1 >= y2 or x2 > width or y2 > length:
        raise ValueError(f"range {text!r} is empty or outside {width} x {length}")
    return Box(x1, x2, y1, y2)


_NUMBER = r"([-+]?\d+(?:\.\d+)?)"


def parse_geo_range(text: str, grid: Grid) -> Box:
    """``lon1/lon2/lat1/lat2`` to the half-open box of pixels between them, clipped to the grid."""
    m = re.fullmatch("/".join([_NUMBER] * 4), text.strip())
    if not m:
        raise ValueError(f"not a geographic range: {text!r}")
    lon1, lon2, lat1, lat2 = map(float, m.groups())
    xs = sorted(half_even((v - grid.corner_lon) / grid.post_lon) for v in (lon1, lon2))
    ys = sorted(half_even((v - grid.corner_lat) / grid.post_lat) for v in (lat1, lat2))
    box = Box(max(0, xs[0]), min(grid.width, xs[1] + 1), max(0, ys[0]), min(grid.length, ys[1] + 1))
    if box.x1 >= box.x2 or box.y1 >= box.y2:
        raise ValueError(f"{text!r} lies outside the grid")
    return box


def parse_line(text: str, width: int, length: int) -> tuple[int, int, int, int]:
    """``x1,y1/x2,y2`` to end points."""
    m = re.fullmatch(r"\s*(\d+),(\d+)/(\d+),(\d+)\s*", text)
    if not m:
        raise ValueError(f"not a line: {text!r}")
    x1, y1, x2, y2 = map(int, m.groups())
    if max(x1, x2) >= width or max(y1, y2) >= length:
        raise ValueError(f"line {text!r} leaves {width} x {length}")
    return x1, y1, x2, y2


def parse_geo_line(text: str, grid: Grid) -> tuple[int, int, int, int]:
    """``lon1,lat1/lon2,lat2`` to end points in pixels."""
    m = re.fullmatch(f"{_NUMBER},{_NUMBER}/{_NUMBER},{_NUMBER}", text.strip())
    if not m:
        raise ValueError(f"not a geographic line: {text!r}")
    lon1, lat1, lon2, lat2 = map(float, m.groups())
    x = [half_even((v - grid.corner_lon) / grid.post_lon) for v in (lon1, lon2)]
    y = [half_even((v - grid.corner_lat) / grid.post_lat) for v in (lat1, lat2)]
    return parse_line(f"{x[0]},{y[0]}/{x[1]},{y[1]}", grid.width, grid.length)


def parse_point(text: str, width: int, length: int) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)/(\d+)\s*", text)
    if not m or int(m[1]) >= width or int(m[2]) >= length:
        raise ValueError(f"not a pixel of {width} x {length}: {text!r}")
    return int(m[1]), int(m[2])


def half_even(v: float) -> int:
    return round(v)


@dataclass(frozen=True)
class Sensor:
    frequency_hz: float = LIGHT_SPEED / 0.0554658

    @property
    def wavelength(self) -> float:
        return LIGHT_SPEED / self.frequency_hz

    @property
    def mm_per_radian(self) -> float:
        """Negative: positive displacement is towards the satellite."""
        return -self.wavelength / 4 / math.pi * 1000

    @property
    def band(self) -> str:
        return "L" if self.wavelength > 0.2 else "C"

    @property
    def wrap_cycle(self) -> float:
        """Cycles shown per colour cycle."""
        return 1.5 if self.band == "L" else 3.0


@dataclass(frozen=True)
class Thresholds:
    """Mask thresholds: values below the first three and above the others are masked; equality keeps."""

    coh_avg: float = 0.05
    n_unw: float = 42.0
    max_run: float = 1.0
    vstd: float = 100.0
    n_gap: float = 10.0
    stc: float = 5.0
    n_noloop: float = 50.0
    n_loop_err: float = 5.0
    resid_rms: float = 2.0


def default_thresholds(sensor: Sensor, n_epochs: int) -> Thresholds:
    """Fixed values, per band; the least number of observations is 1.5 times (C) or once (L) the number of epochs."""
    if sensor.band == "L":
        return Thresholds(coh_avg=0.01, n_unw=float(n_epochs), max_run=1.0, vstd=200.0, n_gap=1.0, stc=10.0, n_noloop=50.0, n_loop_err=1.0, resid_rms=10.0)
    return Thresholds(n_unw=float(int(n_epochs * 1.5)))


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, by step."""

    unw_ratio: float = 0.3
    coherence: float = 0.05
    loop_rms: float = 1.5
    gamma: float = 1e-4
    bootstrap: int = 100
    #: Width of the filter in time; 0: three mean intervals of the epochs.
    smooth_years: float = 0.0
    smooth_km: float = 2.0
    #: None: those of the sensor's band and the number of epochs.
    thresholds: Thresholds | None = None
