"""Plane geometry on rings (arrays of (x, y) structs, closed or not) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
SEMI_MAJOR = 6378137.0
E2 = 0.0066943799901413165


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of (lon0, lat0), second order; within 0.1 mm at 1.5 km."""
    phi = F.radians(lat0)
    s, c = F.sin(phi), F.cos(phi)
    w2 = 1 - E2 * s * s
    n, m = SEMI_MAJOR / F.sqrt(w2), SEMI_MAJOR * (1 - E2) / (w2 * F.sqrt(w2))
    dp, dl = F.radians(lat - lat0), F.radians(lon - lon0)
    x = dl * (n * c - m * s * dp)
    y = m * dp + 0.5 * n * s * c * dl * dl + 1.5 * m * E2 * s * c / w2 * dp * dp
    return F.struct(x.alias("x"), y.alias("y"))


#: Steps of the geodesic series; each gains three digits or more.
STEPS = 8
FLATTENING = 1 - math.sqrt(1 - E2)
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)


def _series(cos2_alpha: Column) -> tuple[Column, Column]:
    """The two coefficients of the arc length along a geodesic, by its azimuth at the equator."""
    u2 = cos2_alpha * (E2 / (1 - E2))
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _arc_correction(b: Column, sin_s: Column, cos_s: Column, mid: Column) -> Column:
    return b * sin_s * (mid + b / 4 * (cos_s * (2 * mid * mid - 1) - b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))


def geodesic_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of (lon0, lat0), azimuthal equidistant, exact to below 1 mm up to a few thousand km.

    The distance and direction of the geodesic, by a fixed number of steps of its series on the auxiliary sphere.
    """
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(p))) for p in (lat0, lat))
    known = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon - lon0).alias("l"))

    def values(k: Column, turn: Column) -> dict[str, Column]:
        a, b = k["c2"] * F.sin(turn), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(turn)
        sin_s, cos_s = F.hypot(a, b), k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(turn)
        sin_alpha = k["c1"] * k["c2"] * F.sin(turn) / F.greatest(sin_s, F.lit(1e-300))
        cos2 = F.greatest(1 - sin_alpha * sin_alpha, F.lit(1e-300))
        return {"a": a, "b": b, "sin_s": sin_s, "cos_s": cos_s, "sin_alpha": sin_alpha, "cos2": cos2, "mid": cos_s - 2 * k["s1"] * k["s2"] / cos2}

    def state(k: Column, turn: Column) -> Column:
        return F.struct(k.alias("k"), *[v.alias(c) for c, v in values(k, turn).items()])

    def step(x: Column, _: Column) -> Column:
        c = FLATTENING / 16 * x["cos2"] * (4 + FLATTENING * (4 - 3 * x["cos2"]))
        sigma = F.atan2(x["sin_s"], x["cos_s"])
        turn = x["k"]["l"] + (1 - c) * FLATTENING * x["sin_alpha"] * (sigma + c * x["sin_s"] * (x["mid"] + c * x["cos_s"] * (2 * x["mid"] * x["mid"] - 1)))
        return state(x["k"], turn)

    def xy(x: Column) -> Column:
        big, small = _series(x["cos2"])
        long = SEMI_MINOR * big * (F.atan2(x["sin_s"], x["cos_s"]) - _arc_correction(small, x["sin_s"], x["cos_s"], x["mid"]))
        span = F.greatest(x["sin_s"], F.lit(1e-300))  # the sine and cosine of the azimuth are a / span and b / span
        return F.struct((long * x["a"] / span).alias("x"), (long * x["b"] / span).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state(known, known["l"]), step, xy)


def geodesic_lonlat(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    """The point (lon, lat) so many metres east and north of (lon0, lat0): the inverse of geodesic_xy."""
    u1, long = F.atan((1 - FLATTENING) * F.tan(F.radians(lat0))), F.hypot(x, y)
    sin_a, cos_a = (F.when(long > 0, v / F.greatest(long, F.lit(1e-300))).otherwise(n) for v, n in ((x, 0.0), (y, 1.0)))
    sin_alpha = F.cos(u1) * sin_a
    big, small = _series(1 - sin_alpha * sin_alpha)
    known = F.struct(
        F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), sin_a.alias("sa"), cos_a.alias("ca"), sin_alpha.alias("sin_alpha"), F.atan2(F.tan(u1), cos_a).alias("start"), small.alias("small"), (long / (SEMI_MINOR * big)).alias("first"), lon0.alias("lon0")
    )

    def step(s: Column, _: Column) -> Column:
        k, sigma = s["k"], s["sigma"]
        return F.struct(k.alias("k"), (k["first"] + _arc_correction(k["small"], F.sin(sigma), F.cos(sigma), F.cos(2 * k["start"] + sigma))).alias("sigma"))

    def lonlat(s: Column) -> Column:
        k, sin_s, cos_s, mid = s["k"], F.sin(s["sigma"]), F.cos(s["sigma"]), F.cos(2 * s["k"]["start"] + s["sigma"])
        across = k["s1"] * sin_s - k["c1"] * cos_s * k["ca"]
        lat = F.atan2(k["s1"] * cos_s + k["c1"] * sin_s * k["ca"], (1 - FLATTENING) * F.hypot(k["sin_alpha"], across))
        turn = F.atan2(sin_s * k["sa"], k["c1"] * cos_s - k["s1"] * sin_s * k["ca"])
        cos2 = 1 - k["sin_alpha"] * k["sin_alpha"]
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        turn = turn - (1 - c) * FLATTENING * k["sin_alpha"] * (s["sigma"] + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        return F.struct((k["lon0"] + F.degrees(turn)).alias("lon"), F.degrees(lat).alias("lat"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(known.alias("k"), known["first"].alias("sigma")), step, lonlat)


def rotated(ring: Column, degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(ring, lambda p: F.struct((p["x"] * c - p["y"] * s).alias("x"), (p["x"] * s + p["y"] * c).alias("y")))


def _edges(ring: Column) -> Column:
    """(x, y, x2, y2) of each edge, the closing one included."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("x2"), q["y"].alias("y2")))


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x"] * e["y2"] - e["x2"] * e["y"])) / 2


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt((e["x2"] - e["x"]) ** 2 + (e["y2"] - e["y"]) ** 2))


def compactness(ring: Column) -> Column:
    return 4 * F.pi() * area(ring) / (perimeter(ring) ** 2)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether a ring has a point inside."""
    crossings = F.filter(_edges(ring), lambda e: ((e["y"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x"]) * (y - e["y"]) / (e["y2"] - e["y"]) + e["x"]))
    return F.size(crossings) % 2 == 1


def distance(ring: Column, x: Column, y: Column) -> Column:
    """From a point to a ring's boundary."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x"], e["y2"] - e["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x"]) * dx + (y - e["y"]) * dy) / long))).otherwise(0.0)
        return F.sqrt((e["x"] + t * dx - x) ** 2 + (e["y"] + t * dy - y) ** 2)

    return F.array_min(F.transform(_edges(ring), to_edge))


def sections(length: Column, most: float, gap: float) -> Column:
    """Into how many equal sections an axis is cut so that none is longer than most."""
    return F.when(length <= most, F.lit(1)).otherwise(F.ceil((length + gap) / (most + gap)).cast("int"))


def panel_corners(x: Column, y: Column, width: Column, height: Column, pitch: Column, azimuth: Column) -> Column:
    """The corners of a panel in plan: foreshortened down the slope, turned by its azimuth."""
    h = height * F.cos(F.radians(pitch))
    c, s = F.cos(F.radians(-azimuth)), F.sin(F.radians(-azimuth))
    corners = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    return F.array(*(F.struct((x + a * width * c - b * h * s).alias("x"), (y + a * width * s + b * h * c).alias("y")) for a, b in corners))


def modules_in_rectangle(width: Column, height: Column, along: float, depth: float, pitch: float, gap: float = 0.02, phases: int = 8) -> Column:
    """How many modules rows in a width x height rectangle hold: the best of some row phases."""
    per_row = F.floor((width + gap) / (along + gap) + 1e-9)
    counts = F.transform(F.sequence(F.lit(0), F.lit(phases - 1)), lambda k: F.greatest(F.lit(0), F.floor((height - depth - pitch * k / phases + 1e-9) / pitch) + 1))
    return (F.greatest(per_row, F.lit(0)) * F.array_max(counts)).cast("long")
