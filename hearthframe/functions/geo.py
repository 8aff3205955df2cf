"""Plane geometry and map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: WGS 84 and the northern transverse Mercator zone 36. ----
A, FLATTENING, SCALE, EASTING, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 33.0
# ---- End of fixed values. ----
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm(lon: Column, lat: Column, meridian: float = MERIDIAN) -> Column:
    """struct(x, y) in metres by Krueger's series to the third order (sub-millimetre within the zone)."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = F.sin(phi)
    atanh = lambda v: 0.5 * F.ln((1 + v) / (1 - v))
    t = F.sinh(atanh(s) - _E * atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((EASTING + SCALE * _RECTIFYING * east).alias("x"), (SCALE * _RECTIFYING * north).alias("y"))


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    phi, lam = f"radians({lat})", f"radians({lon} - {MERIDIAN})"
    s = f"sin({phi})"
    atanh = lambda v: f"(0.5e0 * ln((1 + {v}) / (1 - {v})))"
    q = f"({atanh(s)} - {_E!r}e0 * {atanh(f'({_E!r}e0 * {s})')})"
    t = f"((exp({q}) - exp(-{q})) / 2)"
    xi, eta = f"atan2({t}, cos({lam}))", atanh(f"(sin({lam}) / sqrt(1 + {t} * {t}))")
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        e2 = f"({2 * j} * {eta})"
        north += f" + {a!r} * sin({2 * j} * {xi}) * ((exp({e2}) + exp(-{e2})) / 2)"
        east += f" + {a!r} * cos({2 * j} * {xi}) * ((exp({e2}) - exp(-{e2})) / 2)"
    return f"({EASTING} + {SCALE * _RECTIFYING!r}e0 * ({east}))", f"({SCALE * _RECTIFYING!r}e0 * ({north}))"


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the segment a to b; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    at = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return distance(px, py, ax + at * dx, ay + at * dy)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting against an array of (x, y) vertices: inside, with lower and left edges counted in."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, ahead, lambda a, b: (((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("int"))
    return F.aggregate(crossed, F.lit(0), lambda s, c: s + F.coalesce(c, F.lit(0))) % 2 == 1


def sector(dx: Column, dy: Column, parts: int = 8) -> Column:
    """Sector number by angle, anticlockwise from east."""
    return F.floor(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)) / (360.0 / parts)).cast("int")
