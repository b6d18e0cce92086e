"""Distances and polygons as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import GeoPoint

EARTH = 6_371_000.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere; arguments are columns or numbers, in degrees."""
    a1, o1, a2, o2 = (F.radians(x if isinstance(x, Column) else F.lit(float(x))) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def vincenty_array(lat1, lon1, lat2, lon2, rounds: int = 1000) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid, for arrays of degrees; NaN where the iteration doesn't settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2)))
    u1, u2, span = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    out = np.full(span.shape, np.nan)
    lam, todo = span.copy(), np.isfinite(span) & np.isfinite(u1) & np.isfinite(u2)
    same = todo & (lat1 == lat2) & (lon1 == lon2)
    out[same] = 0.0
    todo &= ~same
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not todo.any():
                break
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = c1 * c2 * sl / ss
            c2a = 1 - sa**2
            cm = np.where(c2a == 0, 0.0, cs - 2 * s1 * s2 / c2a)
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            settled = todo & (np.abs(new - lam) < 1e-12)
            zero = todo & (ss == 0)
            k = c2a * (a**2 - b**2) / b**2
            big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
            small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            delta = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
            out = np.where(settled, b * big * (sigma - delta), out)
            out[zero] = 0.0
            todo = todo & ~settled & ~zero
            lam = np.where(todo, new, lam)
    return out


@F.pandas_udf(T.DoubleType())
def _vincenty(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_array(lat1, lon1, lat2, lon2))


def vincenty(lat1, lon1, lat2, lon2) -> Column:
    return _vincenty(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2)))


def in_polygon(lat: Column, lon: Column, polygon: Sequence[GeoPoint]) -> Column:
    """Even-odd rule over raw degrees; one predicate for each edge, joined by exclusive or."""
    parts = []
    for k, here in enumerate(polygon):
        before = polygon[k - 1]
        if here.lat == before.lat:
            continue
        crosses = (F.lit(here.lat) > lat) != (F.lit(before.lat) > lat)
        at = (before.lon - here.lon) * (lat - here.lat) / (before.lat - here.lat) + here.lon
        parts.append(crosses & (lon < at))
    return reduce(lambda x, y: x != y, parts) if parts else F.lit(False)


def centroid(polygon: Sequence[GeoPoint]) -> GeoPoint:
    """Area-weighted centre; NaN for a polygon without area."""
    area = x = y = 0.0
    for k, q in enumerate(polygon):
        p = polygon[k - 1]
        cross = p.lon * q.lat - q.lon * p.lat
        area += cross
        x += (p.lon + q.lon) * cross
        y += (p.lat + q.lat) * cross
    if not area:
        return GeoPoint(math.nan, math.nan)
    return GeoPoint(y / (3 * area), x / (3 * area))


def box(lat: Column, lon: Column, centre: GeoPoint, metres: float) -> Column:
    """A cheap bound for a radius, which scans can push down; true wherever the exact test may be."""
    pad = math.degrees(metres / EARTH) * 1.01 + 1e-9
    inside = lat.between(centre.lat - pad, centre.lat + pad)
    top = max(abs(centre.lat - pad), abs(centre.lat + pad))
    if top >= 89:
        return inside
    wide = pad / math.cos(math.radians(top))
    if centre.lon - wide < -180 or centre.lon + wide > 180:
        return inside
    return inside & lon.between(centre.lon - wide, centre.lon + wide)
