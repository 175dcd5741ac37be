"""Plane and earth geometry on doubles and on arrays of (x, y) structs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, EARTH_ROUND_M, EARTH_MI = 6371008.8, 6371000.0, 3958.8
#: WGS 84 and the transverse Mercator zone 11 north.
_A, _E2, _K0, _LON0 = 6378137.0, 0.00669438, 0.9996, math.radians(-117)
_EP2 = _E2 / (1 - _E2)


def lonlat_to_utm(lon: Column, lat: Column) -> Column:
    """(x, y) in metres, by the series for the transverse Mercator projection."""
    phi = F.radians(lat)
    n = _A / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2)
    a = (F.radians(lon) - _LON0) * F.cos(phi)
    e4, e6 = _E2**2, _E2**3
    m = _A * (
        (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    x = _K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * F.pow(a, 5) / 120) + 500000.0
    y = _K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * F.pow(a, 6) / 720))
    return F.struct(x.alias("x"), y.alias("y"))


def utm_to_lonlat(x: Column, y: Column) -> Column:
    """(lon, lat) in degrees, by the inverse series."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = y / _K0 / (_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = mu
    for k, factor in ((2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96)):
        phi = phi + factor * F.sin(k * mu)
    sin2 = F.pow(F.sin(phi), 2)
    n, r = _A / F.sqrt(1 - _E2 * sin2), _A * (1 - _E2) / F.pow(1 - _E2 * sin2, 1.5)
    t, c = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2)
    d = (x - 500000.0) / (n * _K0)
    up = d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6) / 720
    side = d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120
    return F.struct(F.degrees(_LON0 + side / F.cos(phi)).alias("lon"), F.degrees(phi - n * F.tan(phi) / r * up).alias("lat"))


def world_px(lon: Column, lat: Column, zoom: int, tile: int = 256) -> Column:
    """(x, y) in web Mercator pixels of a zoom."""
    size = float(tile << zoom)
    s = F.sin(F.radians(lat))
    return F.struct(((lon + 180.0) / 360.0 * size).alias("x"), ((0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * size).alias("y"))


def lonlat_to_tile(lon: Column, lat: Column, zoom: int) -> Column:
    px = world_px(lon, lat, zoom, 1)
    return F.struct(F.floor(px["x"]).alias("x"), F.floor(px["y"]).alias("y"))


def tile_pixel_lonlat(zoom: int, tile_x: Column, tile_y: Column, col: Column, row: Column, tile: int = 256) -> Column:
    """(lon, lat) of a pixel's centre."""
    n = float(1 << zoom)
    fx, fy = (tile_x + (col + 0.5) / tile) / n, (tile_y + (row + 0.5) / tile) / n
    return F.struct((fx * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * fy)))).alias("lat"))


def cell_of(x: Column, y: Column, size: float = 1000.0) -> Column:
    return F.struct(F.floor(x / size).cast("int").alias("cell_e"), F.floor(y / size).cast("int").alias("cell_n"))


def tile_id(cell_e: Column, cell_n: Column) -> Column:
    return F.format_string("cty-e%d-n%d", cell_e, cell_n)


def cells_of_bbox(x1: Column, y1: Column, x2: Column, y2: Column, size: float | Column = 1000.0) -> Column:
    """All cells that a box touches, as an array."""
    side = lambda a, b: F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int"))
    columns = F.transform(side(x1, x2), lambda e: F.transform(side(y1, y2), lambda n: F.struct(e.alias("cell_e"), n.alias("cell_n"))))
    return F.flatten(columns)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2.0 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column, radius: float = EARTH_ROUND_M) -> Column:
    """(x, y) in metres on the plane that touches the earth at a point."""
    return F.struct((F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius).alias("x"), (F.radians(lat - lat0) * radius).alias("y"))


def track_frame(x: Column, y: Column, heading: Column) -> Column:
    """(along, across) of an offset against a heading in degrees from north; across is positive to the right."""
    h = F.radians(heading)
    return F.struct((x * F.sin(h) + y * F.cos(h)).alias("along"), (x * F.cos(h) - y * F.sin(h)).alias("across"))


def angle_diff(a: Column, b: Column) -> Column:
    """Degrees between two headings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def line_angle(dx: Column, dy: Column) -> Column:
    """Direction of an undirected line, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def line_angle_diff(a: Column, b: Column) -> Column:
    """Degrees between undirected lines, 0 to 90."""
    d = F.abs(F.pmod(a - b, F.lit(180.0)))
    return F.least(d, 180.0 - d)


def interp_heading(a: Column, b: Column, part: Column) -> Column:
    """Between two headings along the shorter arc."""
    return F.pmod(a + (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) * part, F.lit(360.0))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(distance, part): to a segment, and how far along it the nearest point lies, 0 to 1."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    part = F.when(long2 > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / long2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(F.sqrt(F.pow(px - ax - part * dx, 2) + F.pow(py - ay - part * dy, 2)).alias("distance"), part.alias("part"))


def far_from_segments(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The distance of point_segment() over arrays, with the same arithmetic."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    some = long2 > 0
    part = np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(some, long2, 1.0), 0.0, 1.0) * some
    return np.sqrt((x - ax - part * dx) ** 2 + (y - ay - part * dy) ** 2)


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """(lo, hi): the part of a segment inside a box; null where none is (Liang-Barsky)."""
    lo, hi, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((ax - bx, ax - x1), (bx - ax, x2 - ax), (ay - by, ay - y1), (by - ay, y2 - ay)):
        lo = F.greatest(lo, F.when(p < 0, q / p))
        hi = F.least(hi, F.when(p > 0, q / p))
        outside = outside | ((p == 0) & (q < 0))
    return F.when(~outside & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def clip_time(t1: Column, t2: Column, start: Column, end: Column) -> Column:
    """(lo, hi): the part of a step in time inside [start, end]; null where none is."""
    long = t2 - t1
    lo = F.greatest(F.lit(0.0), (start - t1) / long)
    hi = F.least(F.lit(1.0), (end - t1) / long)
    return F.when((long > 0) & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def lerp(a: Column, b: Column, part: Column) -> Column:
    return a + (b - a) * part


def lerp_sq(a: Column, b: Column, part: Column) -> Column:
    """Interpolate squares and keep the sign; across a change of sign, the root law on the positive side."""
    inside = F.sqrt(F.greatest(a * a + part * (b * b - a * a), F.lit(0.0)))
    return F.when((a >= 0) & (b >= 0), inside).when((a <= 0) & (b <= 0), -inside).when(a < b, a + (b - a) * F.sqrt(part)).otherwise(b + (a - b) * F.sqrt(1.0 - part))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once a row however often it is named."""
    return F.transform(F.array(value), then)[0]


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs (a, b) of a line or closed ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Metres from a point to the border of a ring."""
    return F.array_min(F.transform(edges(ring), lambda e: point_segment(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])["distance"]))


def inscribed_radius(ring: Column, steps: int = 16, rounds: int = 3) -> Column:
    """Radius of about the largest circle inside a ring: the best of a grid of points, refined around it."""
    span = lambda axis: (F.array_min(F.transform(ring, lambda p: p[axis])), F.array_max(F.transform(ring, lambda p: p[axis])))
    (x1, x2), (y1, y2) = span("x"), span("y")
    start = F.struct(F.lit(-1.0).alias("r"), ((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"), ((x2 - x1) / 2).alias("w"), ((y2 - y1) / 2).alias("h"))
    places = F.sequence(F.lit(0), F.lit(steps))

    def closer(at: Column, _: Column) -> Column:
        x, y = (lambda i: at["x"] + (2 * i / steps - 1) * at["w"]), (lambda j: at["y"] + (2 * j / steps - 1) * at["h"])
        one = lambda i, j: F.struct(F.when(in_ring(x(i), y(j), ring), ring_distance(x(i), y(j), ring)).otherwise(-1.0).alias("r"), x(i).alias("x"), y(j).alias("y"))
        best = F.array_max(F.flatten(F.transform(places, lambda i: F.transform(places, lambda j: one(i, j)))))
        return F.struct(best["r"].alias("r"), best["x"].alias("x"), best["y"].alias("y"), (at["w"] * 2 / steps).alias("w"), (at["h"] * 2 / steps).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, closer)["r"]


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring, by crossings."""
    crossed = lambda s: ((s["a"]["y"] > py) != (s["b"]["y"] > py)) & (px < (s["b"]["x"] - s["a"]["x"]) * (py - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a closed ring that aren't neighbours cross."""
    side = lambda a, b, p: F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
    apart = lambda e, f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    def crossed(es: Column) -> Column:
        n = F.size(es)
        later = lambda i: F.slice(es, i + 3, F.greatest(n - i - 2 - (i == 0).cast("int"), F.lit(0)))
        return F.exists(F.transform(es, lambda e, i: F.exists(later(i), lambda f: apart(e, f))), lambda x: x)

    return once(edges(ring), crossed)


def bbox_intersects(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    return (ax1 <= bx2) & (ax2 >= bx1) & (ay1 <= by2) & (ay2 >= by1)


def expand_point(lon: Column, lat: Column, metres: float) -> Column:
    """Box of a half width in metres around a point, in degrees."""
    dy = metres / 111320.0
    dx = dy / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return F.struct((lon - dx).alias("x1"), (lat - dy).alias("y1"), (lon + dx).alias("x2"), (lat + dy).alias("y2"))


def ring_area(ring: Column) -> Column:
    """The area of ring_stats() alone."""

    def area(own: Column) -> Column:
        cross = lambda s: (s["a"]["x"] - own[0]["x"]) * (s["b"]["y"] - own[0]["y"]) - (s["b"]["x"] - own[0]["x"]) * (s["a"]["y"] - own[0]["y"])
        return F.abs(F.aggregate(edges(own), F.lit(0.0), lambda acc, s: acc + cross(s))) / 2.0

    return once(ring, area)


def ring_stats(ring: Column) -> Column:
    """(cx, cy, area, perimeter, compactness, vertices, aspect) of a closed ring.

    aspect is the short side over the long side of the smallest box aligned to an edge, exact for convex rings.
    """
    return once(ring, lambda own: once(edges(own), lambda es: _ring_stats(own, es)))


def _ring_stats(ring: Column, es: Column) -> Column:
    origin = ring[0]
    cross = lambda s: (s["a"]["x"] - origin["x"]) * (s["b"]["y"] - origin["y"]) - (s["b"]["x"] - origin["x"]) * (s["a"]["y"] - origin["y"])
    total = lambda f: F.aggregate(es, F.lit(0.0), lambda acc, s: acc + f(s))
    double = total(cross)
    area = F.abs(double) / 2.0
    long = total(lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2)))
    centre = lambda axis: F.when(double != 0, origin[axis] + total(lambda s: (s["a"][axis] + s["b"][axis] - 2 * origin[axis]) * cross(s)) / (3.0 * double)).otherwise(origin[axis])

    def box(s: Column) -> Column:
        angle = F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"])
        along = F.transform(ring, lambda p: p["x"] * F.cos(angle) + p["y"] * F.sin(angle))
        across = F.transform(ring, lambda p: p["y"] * F.cos(angle) - p["x"] * F.sin(angle))
        w, h = F.array_max(along) - F.array_min(along), F.array_max(across) - F.array_min(across)
        return F.struct((w * h).alias("area"), F.when(F.greatest(w, h) > 0, F.least(w, h) / F.greatest(w, h)).alias("aspect"))

    aspect = F.array_min(F.transform(es, box))["aspect"]
    return F.struct(
        centre("x").alias("cx"), centre("y").alias("cy"), area.alias("area"), long.alias("perimeter"),
        F.when(long > 0, 4 * math.pi * area / (long * long)).alias("compactness"), (F.size(ring) - 1).alias("vertices"), aspect.alias("aspect"),
    )


def same_ring(a: Column, b: Column, tolerance: float = 5e-7) -> Column:
    """Whether two closed rings are the same up to their first vertex, direction and a tolerance."""
    n = F.size(a) - 1
    close = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    places = F.sequence(F.lit(0), n - 1)
    matches = lambda step: F.exists(places, lambda o: F.forall(places, lambda i: close(F.get(a, i), F.get(b, F.pmod(o + step * i, n)))))
    return F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(matches(1) | matches(-1))
