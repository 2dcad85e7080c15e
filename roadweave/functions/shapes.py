"""Polylines and polygons as arrays of struct<x, y>: expressions for Spark's own higher-order functions, so shapes stay in the JVM.

x is longitude and y latitude, or both metres. A null shape gives null; shapes of fewer points than a function needs give null too.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.geo import METRES_PER_DEGREE, RADIUS


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.alias("y"))


def segments(pts: Column) -> Column:
    """struct<a, b> of neighbouring points."""
    return F.arrays_zip(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))).alias("a"), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))).alias("b"))


def ring(pts: Column) -> Column:
    """The segments of a polygon, the closing one included."""
    return segments(F.when(F.element_at(pts, 1) == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.slice(pts, 1, 1))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def metres(a: Column, b: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    h = F.pow(F.sin(F.radians(b["y"] - a["y"]) / 2), 2) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def heading(a: Column, b: Column) -> Column:
    """Initial bearing, 0 to 360 degrees from north; 0 for equal points."""
    d = F.radians(b["x"] - a["x"])
    east = F.sin(d) * F.cos(F.radians(b["y"]))
    north = F.cos(F.radians(a["y"])) * F.sin(F.radians(b["y"])) - F.sin(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.cos(d)
    turned = F.degrees(F.atan2(east, north))
    return F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), F.lit(0.0)).when(turned < 0, turned + 360).otherwise(turned)


def length(pts: Column) -> Column:
    return total(F.transform(segments(pts), lambda s: metres(s["a"], s["b"])))


def along(a: Column, b: Column, share: Column) -> Column:
    """The point at a share of the great circle from a to b."""
    unit = lambda p: F.struct((F.cos(F.radians(p["y"])) * F.cos(F.radians(p["x"]))).alias("x"), (F.cos(F.radians(p["y"])) * F.sin(F.radians(p["x"]))).alias("y"), F.sin(F.radians(p["y"])).alias("z"))

    def between(u: Column) -> Column:
        p, q, w = u["p"], u["q"], u["w"]
        beside = lambda k: (q[k] - p[k] * F.cos(w)) / F.sin(w)
        x, y, z = (F.when(w > 0, p[k] * F.cos(w * share) + beside(k) * F.sin(w * share)).otherwise(p[k]) for k in "xyz")
        return point(F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))

    # by the chord: the arc cosine of the dot product is 0 for points that are a foot apart, and sin(0) then divides
    chord = lambda u: F.sqrt(F.pow(u["p"]["x"] - u["q"]["x"], F.lit(2)) + F.pow(u["p"]["y"] - u["q"]["y"], F.lit(2)) + F.pow(u["p"]["z"] - u["q"]["z"], F.lit(2)))
    angle = lambda u: F.struct(u["p"].alias("p"), u["q"].alias("q"), (2 * F.asin(F.least(F.lit(1.0), chord(u) / 2))).alias("w"))
    met = let(let(F.struct(unit(a).alias("p"), unit(b).alias("q")), angle), between)
    return F.when((share <= 0) | ((a["x"] == b["x"]) & (a["y"] == b["y"])), a).when(share >= 1, b).otherwise(met)


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius in metres of the circle through three points; null where they are in one line."""

    def of(s: Column) -> Column:
        half = (s["a"] + s["b"] + s["c"]) / 2
        square = half * (half - s["a"]) * (half - s["b"]) * (half - s["c"])
        return F.when(square > 0, s["a"] * s["b"] * s["c"] / (4 * F.sqrt(square)))

    return let(F.struct(metres(a, b).alias("a"), metres(b, c).alias("b"), metres(a, c).alias("c")), of)


def curvature(pts: Column) -> Column:
    """0 to 15: the mean over inner points of 1500 m over the radius there, 15 at most; straight places count 0."""
    inner = F.transform(F.sequence(F.lit(1), F.size(pts) - 2), lambda i: F.coalesce(F.least(F.lit(15.0), 1500 / circumradius(F.get(pts, i - 1), F.get(pts, i), F.get(pts, i + 1))), F.lit(0.0)))
    return F.when(F.size(pts) >= 3, total(inner) / (F.size(pts) - 2))


def projected(p: Column, a: Column, b: Column, scale: Column) -> Column:
    """struct<point, t>: the nearest point of a segment, with x scaled by ``scale`` for the comparison, and its share of the segment."""
    dx, dy = (b["x"] - a["x"]) * scale, b["y"] - a["y"]
    t = F.try_divide((p["x"] - a["x"]) * scale * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(0.0))
    return let(t, lambda k: F.struct(point(a["x"] + k * (b["x"] - a["x"]), a["y"] + k * (b["y"] - a["y"])).alias("point"), k.alias("t")))


def snapped(p: Column, pts: Column) -> Column:
    """struct<distance, segment, t, point>: the nearest place of a polyline; the first of equally near segments."""
    scale = F.cos(F.radians(p["y"]))
    each = F.transform(segments(pts), lambda s, i: let(projected(p, s["a"], s["b"], scale), lambda q: F.struct(metres(p, q["point"]).alias("distance"), i.alias("segment"), q["t"].alias("t"), q["point"].alias("point"))))
    return F.array_min(each)


def percent_along(pts: Column, place: Column) -> Column:
    """0 to 1: the part of a polyline's length before a snapped place."""
    parts = F.transform(segments(pts), lambda s, i: metres(s["a"], s["b"]) * F.when(i < place["segment"], 1.0).when(i == place["segment"], place["t"]).otherwise(0.0))
    return F.coalesce(F.try_divide(total(parts), length(pts)), F.lit(0.0))


def is_left(a: Column, b: Column, p: Column) -> Column:
    """Positive if p is to the left of the line from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (p["x"] - a["x"]) * (b["y"] - a["y"])


def winding(p: Column, polygon: Column) -> Column:
    """How often a polygon winds around a point; not 0 means that it is inside."""

    def step(s: Column) -> Column:
        up, down = (s["a"]["y"] <= p["y"]) & (s["b"]["y"] > p["y"]), (s["a"]["y"] > p["y"]) & (s["b"]["y"] <= p["y"])
        side = is_left(s["a"], s["b"], p)
        return F.when(up & (side > 0), 1).when(down & (side < 0), -1).otherwise(0)

    return F.aggregate(F.transform(ring(polygon), step), F.lit(0), lambda s, v: s + v)


def even_odd(p: Column, polygon: Column) -> Column:
    """Whether a ray to the right crosses a polygon an odd number of times."""
    crosses = lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * F.try_divide(p["y"] - s["a"]["y"], s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(ring(polygon), crosses)) % 2 == 1


def area(polygon: Column) -> Column:
    """Signed area, positive counter-clockwise; the closing edge counts."""
    return total(F.transform(ring(polygon), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def crossing(s: Column, t: Column) -> Column:
    """Whether two segments properly cross."""
    return (is_left(s["a"], s["b"], t["a"]) * is_left(s["a"], s["b"], t["b"]) < 0) & (is_left(t["a"], t["b"], s["a"]) * is_left(t["a"], t["b"], s["b"]) < 0)


def meeting(s: Column, t: Column) -> Column:
    """The point where two segments cross, else null."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    ex, ey = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
    k = F.try_divide((t["a"]["x"] - s["a"]["x"]) * ey - (t["a"]["y"] - s["a"]["y"]) * ex, dx * ey - dy * ex)
    return F.when(crossing(s, t), point(s["a"]["x"] + k * dx, s["a"]["y"] + k * dy))


def self_crossings(pts: Column) -> Column:
    """Places where a polyline crosses itself: struct<i, j, point> of the segments that do."""
    both = lambda segs: F.flatten(F.transform(segs, lambda s, i: F.transform(segs, lambda t, j: F.struct(i.alias("i"), j.alias("j"), F.when(j > i + 1, meeting(s, t)).alias("point")))))
    return F.filter(let(segments(pts), both), lambda c: c["point"].isNotNull())


def hausdorff(a: Column, b: Column) -> Column:
    """The farthest that a point of one polyline is from the other, both ways; planar."""
    flat = lambda p, s: let(projected(p, s["a"], s["b"], F.lit(1.0)), lambda q: F.sqrt(F.pow(p["x"] - q["point"]["x"], 2) + F.pow(p["y"] - q["point"]["y"], 2)))
    one_way = lambda u, v: F.array_max(F.transform(u, lambda p: F.array_min(F.transform(segments(v), lambda s: flat(p, s)))))
    return F.greatest(one_way(a, b), one_way(b, a))


def half_plane(pts: Column, axis: str, limit: float, keep_above: bool) -> Column:
    """One pass of polygon clipping over an open polyline: points inside, and where it crosses the limit."""
    inside = lambda p: (p[axis] >= limit) if keep_above else (p[axis] <= limit)
    other = "y" if axis == "x" else "x"

    def cut(a: Column, b: Column) -> Column:
        at = a[other] + (b[other] - a[other]) * (limit - a[axis]) / (b[axis] - a[axis])
        return point(F.lit(limit), at) if axis == "x" else point(at, F.lit(limit))

    none = F.array().cast("array<struct<x:double,y:double>>")

    def step(b: Column, i: Column) -> Column:
        a = F.get(pts, i - 1)
        enters = F.when((i > 0) & (inside(a) != inside(b)), F.array(cut(a, b))).otherwise(none)
        return F.concat(F.coalesce(enters, none), F.when(inside(b), F.array(b)).otherwise(none))

    return F.flatten(F.transform(pts, step))


def clipped(pts: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A polyline clipped to a box by its four half planes."""
    for axis, limit, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        pts = let(pts, functools.partial(lambda axis, limit, above, p: half_plane(p, axis, limit, above), axis, limit, above))
    return pts


def place_at(pts: Column, distance: Column) -> Column:
    """The point that many metres along a polyline, its ends beyond them."""
    state = F.struct(distance.cast("double").alias("left"), F.lit(None).cast("struct<x:double,y:double>").alias("found"))

    def step(s: Column, seg: Column) -> Column:
        here = metres(seg["a"], seg["b"])
        hit = lambda m: s["found"].isNull() & (s["left"] <= m)
        share = lambda m: F.coalesce(F.try_divide(F.greatest(s["left"], F.lit(0.0)), m), F.lit(0.0))
        found = lambda m: F.when(hit(m), let(share(m), lambda k: along(seg["a"], seg["b"], k))).otherwise(s["found"])
        return let(here, lambda m: F.struct((s["left"] - m).alias("left"), found(m).alias("found")))

    return F.coalesce(F.aggregate(segments(pts), state, step)["found"], F.element_at(pts, -1))


def trimmed(pts: Column, begin: Column, end: Column) -> Column:
    """A polyline from one share of its length to another."""

    def cut(s: Column) -> Column:
        whole = s["whole"]
        run = F.transform(segments(s["pts"]), lambda seg: metres(seg["a"], seg["b"]))
        before = F.transform(s["pts"], lambda p, i: F.struct(p.alias("p"), total(F.slice(run, 1, i)).alias("at")))
        kept = F.transform(F.filter(before, lambda q: (q["at"] > whole * begin) & (q["at"] < whole * end)), lambda q: q["p"])
        return F.concat(F.array(place_at(s["pts"], whole * begin)), kept, F.array(place_at(s["pts"], whole * end)))

    return let(F.struct(pts.alias("pts"), length(pts).alias("whole")), cut)


def resampled(pts: Column, spacing: Column) -> Column:
    """Points every ``spacing`` metres along a polyline, its last point at the end."""
    steps = let(length(pts), lambda whole: F.sequence(F.lit(0), F.floor(whole / spacing).cast("int")))
    return F.concat(F.transform(steps, lambda k: place_at(pts, k * spacing)), F.slice(pts, -1, 1))


def heading_along(pts: Column, distance: Column) -> Column:
    """Heading from a polyline's first point to the place ``distance`` metres on."""
    return let(F.struct(F.element_at(pts, 1).alias("a"), place_at(pts, distance).alias("b")), lambda s: heading(s["a"], s["b"]))


def tangent(pts: Column, index: Column, sample: float = 15.0) -> Column:
    """Heading at a point of a polyline, from ``sample`` metres before it to as many after, or to the polyline's ends."""

    def of(s: Column) -> Column:
        run = F.transform(segments(s["pts"]), lambda seg: metres(seg["a"], seg["b"]))
        here = total(F.slice(run, 1, index))
        ends = let(here, lambda h: F.struct(place_at(s["pts"], F.greatest(h - sample, F.lit(0.0))).alias("a"), place_at(s["pts"], h + sample).alias("b")))
        return let(ends, lambda e: heading(e["a"], e["b"]))

    return let(F.struct(pts.alias("pts")), of)


def tiles_of(pts: Column, size: float) -> Column:
    """The tiles (row, column) of ``size`` degrees that a polyline passes: of each segment's box those that the segment enters."""
    cell = lambda v, low: F.floor((v - low) / size).cast("long")

    def entered(s: Column, r: Column, c: Column) -> Column:
        # Liang-Barsky: the share of the segment within the tile's four sides must not be empty
        lows, highs = [F.lit(0.0)], [F.lit(1.0)]
        empty = F.lit(False)
        for axis, low, at in (("x", -180, c), ("y", -90, r)):
            d, a0, a1 = s["b"][axis] - s["a"][axis], low + at * size - s["a"][axis], low + (at + 1) * size - s["a"][axis]
            lows.append(F.when(d != 0, F.least(F.try_divide(a0, d), F.try_divide(a1, d))).otherwise(0.0))
            highs.append(F.when(d != 0, F.greatest(F.try_divide(a0, d), F.try_divide(a1, d))).otherwise(1.0))
            empty = empty | ((d == 0) & ((a0 > 0) | (a1 <= 0)))
        return ~empty & (F.greatest(*lows) <= F.least(*highs))

    def of(s: Column) -> Column:
        rows = F.sequence(F.least(cell(s["a"]["y"], -90), cell(s["b"]["y"], -90)), F.greatest(cell(s["a"]["y"], -90), cell(s["b"]["y"], -90)))
        cols = F.sequence(F.least(cell(s["a"]["x"], -180), cell(s["b"]["x"], -180)), F.greatest(cell(s["a"]["x"], -180), cell(s["b"]["x"], -180)))
        return F.flatten(F.transform(rows, lambda r: F.filter(F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col"), entered(s, r, c).alias("in"))), lambda t: t["in"])))

    found = F.flatten(F.transform(segments(pts), of))
    return F.array_distinct(F.transform(found, lambda t: F.struct(t["row"], t["col"])))


def circular(value: Column, low: float, high: float) -> Column:
    """A value wrapped into [low, high)."""
    return F.pmod(value - low, F.lit(high - low)) + low


def simplified(xy, tolerance: float):
    """Douglas-Peucker on an (n, 2) array: the indices of the points that stay; for Arrow batches."""
    import numpy as np

    keep, stack = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = xy[i], xy[j] - xy[i]
        inner = xy[i + 1 : j] - a
        t = np.clip(inner @ d / (d @ d), 0, 1) if d @ d else np.zeros(len(inner))
        far = ((inner - t[:, None] * d) ** 2).sum(axis=1)
        k = int(far.argmax())
        if far[k] > tolerance**2:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(keep)


def bounding_circle(xy) -> tuple[float, float, float]:
    """Centre and radius of the least circle around an (n, 2) array: move a circle out to each point that it leaves outside.

    Circles are computed from differences to one of their points, so coordinates far from 0 cost no digits of the radius.
    """
    import numpy as np

    def through(p, q, r=None):
        if r is None:
            c = (p + q) / 2
            return c, float(np.hypot(*(p - c)))
        (bx, by), (ex, ey) = q - p, r - p
        det = bx * ey - by * ex
        if abs(det) <= 1e-15:
            return max((through(a, b) for a, b in ((p, q), (p, r), (q, r))), key=lambda f: f[1])
        b, e = bx * bx + by * by, ex * ex + ey * ey
        c = p + np.array([ey * b - by * e, bx * e - ex * b]) / (2 * det)
        return c, float(np.hypot(*(p - c)))

    outside = lambda p, f: np.hypot(*(p - f[0])) > f[1] + 1e-12
    found = (xy[0], 0.0)
    for i in range(1, len(xy)):
        if outside(xy[i], found):
            found = (xy[i], 0.0)
            for j in range(i):
                if outside(xy[j], found):
                    found = through(xy[j], xy[i])
                    for k in range(j):
                        if outside(xy[k], found):
                            found = through(xy[k], xy[j], xy[i])
    return float(found[0][0]), float(found[0][1]), found[1]
