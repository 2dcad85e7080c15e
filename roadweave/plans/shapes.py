"""Queries on polylines: chunks of traces as shapes. Spark runs higher-order functions over arrays; the DuckDB twins are joins
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import shapes as S
from roadweave.functions.geo import RADIUS
from roadweave.plans import derive
from roadweave.plans.derive import TRACES

CHUNK = 16
#: A row for each point: consecutive points that repeat a place are kept; a jitter keeps places off the lattice.
POINTS = f"""{TRACES}, p AS (SELECT user_id * 1000000 + CAST(floor((seq - 1) / {CHUNK}) AS BIGINT) AS shape, CAST((seq - 1) % {CHUNK} AS INT) AS i,
  5.0E0 + x * 0.001E0 + (event_id % 97) * 0.000003E0 AS x, 52.0E0 + y * 0.001E0 + (event_id % 89) * 0.000004E0 AS y FROM traces)"""
BOX = (5.01, 52.008, 5.035, 52.03)
MIDDLE = (5.0251, 52.0203)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.run(spark, sf_dir, f"WITH {POINTS} SELECT shape, i, x, y FROM p")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return rows.groupBy("shape").agg(pts.alias("pts")).where(F.size("pts") >= 3)


def whole(value, scale: float):
    return F.floor(value * scale + 0.5).cast("long")


def over_shapes(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    return shapes(spark, sf_dir).select("shape", *columns(F.col("pts")))


def each(spark: SparkSession, sf_dir: str, items, columns) -> DataFrame:
    found = shapes(spark, sf_dir).select("shape", F.posexplode(items(F.col("pts"))).alias("k", "v"))
    return found.select("shape", F.col("k").cast("long").alias("k"), *columns(F.col("v")))


def dist(a: str, b: str) -> str:
    """Great-circle metres between points a and b of SQL, by the chord between unit vectors."""
    u = {p: [f"cos(radians({p}.y)) * cos(radians({p}.x))", f"cos(radians({p}.y)) * sin(radians({p}.x))", f"sin(radians({p}.y))"] for p in (a, b)}
    chord = " + ".join(f"pow({m} - {n}, 2)" for m, n in zip(u[a], u[b], strict=True))
    return f"({2 * RADIUS!r} * asin(least(1.0, sqrt({chord}) / 2)))"


Q = f"WITH {POINTS}, ok AS (SELECT shape FROM p GROUP BY shape HAVING count(*) >= 3), q AS (SELECT p.* FROM p JOIN ok USING (shape)), n AS (SELECT shape, max(i) AS last FROM q GROUP BY shape)"
SEG = f"{Q}, seg AS (SELECT a.shape, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, {dist('a', 'b')} AS m FROM q a JOIN q b ON b.shape = a.shape AND b.i = a.i + 1)"
RING = f"{Q}, seg AS (SELECT a.shape, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM q a JOIN n ON n.shape = a.shape JOIN q b ON b.shape = a.shape AND b.i = (a.i + 1) % (n.last + 1))"
RUN = f"{SEG}, run AS (SELECT *, sum(m) OVER (PARTITION BY shape ORDER BY i) - m AS before, sum(m) OVER (PARTITION BY shape) AS total FROM seg)"


def at_metres(name: str, wanted: str) -> str:
    """CTE ``name`` (shape, k, x, y): places of ``wanted`` (shape, k, d) b_y vectors on the sphere."""
    v = {p: [f"cos(radians({y})) * cos(radians({p}x))", f"cos(radians({y})) * sin(radians({p}x))", f"sin(radians({y}))"] for p, y in (("a", "ay"), ("b", "b_y"))}
    mix = [f"CASE WHEN m = 0 THEN {a} ELSE ({a}) * cos(th) + (({b}) - ({a}) * cos(om)) / sin(om) * sin(th) END" for a, b in zip(v["a"], v["b"], strict=True)]
    return f"""{name}_s AS (SELECT w.shape, w.k, r.*, greatest(0.0, least(w.d - r.before, r.m)) / {RADIUS!r} AS th, r.m / {RADIUS!r} AS om,
  row_number() OVER (PARTITION BY w.shape, w.k ORDER BY CASE WHEN w.d <= r.before + r.m THEN r.i ELSE 1000 - r.i END) AS pick FROM ({wanted}) w JOIN run r ON r.shape = w.shape),
{name}_v AS (SELECT shape, k, {mix[0]} AS vx, {mix[1]} AS vy, {mix[2]} AS vz FROM {name}_s WHERE pick = 1),
{name} AS (SELECT shape, k, degrees(atan2(vy, vx)) AS x, degrees(atan2(vz, sqrt(vx * vx + vy * vy))) AS y FROM {name}_v)"""


def bear(a: str, b: str) -> str:
    """Bearing b_y the east and north parts of b on the tangent plane at a."""
    d = f"radians({b}.x - {a}.x)"
    east, north = f"sin({d}) * cos(radians({b}.y))", f"cos(radians({a}.y)) * sin(radians({b}.y)) - sin(radians({a}.y)) * cos(radians({b}.y)) * cos({d})"
    return f"CASE WHEN {a}.x = {b}.x AND {a}.y = {b}.y THEN 0.0 ELSE (CAST(degrees(atan2({east}, {north})) AS DOUBLE) + 360.0) % 360.0 END"


def fix(x: str, scale: str) -> str:
    return f"CAST(floor(({x}) * {scale} + 0.5) AS BIGINT)"


def near(p: tuple[float, float]) -> str:
    """CTEs over seg: the projection of a fixed point on every segment."""
    k = f"cos(radians({p[1]!r}))"
    return f"""pr AS (SELECT *, CASE WHEN ax = bx AND ay = b_y THEN 0.0 ELSE least(1.0, greatest(0.0, (({p[0]!r} - ax) * {k} * (bx - ax) * {k} + ({p[1]!r} - ay) * (b_y - ay)) / (pow((bx - ax) * {k}, 2) + pow(b_y - ay, 2)))) END AS t FROM seg),
 pp AS (SELECT *, {{'x': ax + t * (bx - ax), 'y': ay + t * (b_y - ay)}} AS c FROM pr), pd AS (SELECT *, {dist('me', 'c')} AS d FROM pp, (SELECT {{'x': {p[0]!r}, 'y': {p[1]!r}}} AS me) z)"""


def clip_sql() -> str:
    out, last = [], "q"
    for k, (axis, limit, above) in enumerate((("x", BOX[0], True), ("x", BOX[2], False), ("y", BOX[1], True), ("y", BOX[3], False))):
        other, op = "y" if axis == "x" else "x", ">=" if above else "<="
        spot = f"p{other} + ({other} - p{other}) * ({limit!r} - p{axis}) / ({axis} - p{axis})"
        cols = f"{limit!r}::DOUBLE AS x, {spot} AS y" if axis == "x" else f"{spot} AS x, {limit!r}::DOUBLE AS y"
        out.append(f"""l{k} AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {last} WINDOW w AS (PARTITION BY shape ORDER BY i)),
 c{k} AS (SELECT shape, row_number() OVER (PARTITION BY shape ORDER BY i, s) AS i, x, y FROM (SELECT shape, i, 1 AS s, x, y FROM l{k} WHERE {axis} {op} {limit!r}
  UNION ALL SELECT shape, i, 0, {cols} FROM l{k} WHERE px IS NOT NULL AND (p{axis} {op} {limit!r}) <> ({axis} {op} {limit!r})) u)""")
        last = f"c{k}"
    return ", ".join(out)


CROSS = "((s.bx - s.ax) * (t.ay - s.ay) - (t.ax - s.ax) * (s.b_y - s.ay)) * ((s.bx - s.ax) * (t.b_y - s.ay) - (t.bx - s.ax) * (s.b_y - s.ay)) < 0 AND ((t.bx - t.ax) * (s.ay - t.ay) - (s.ax - t.ax) * (t.b_y - t.ay)) * ((t.bx - t.ax) * (s.b_y - t.ay) - (s.bx - t.ax) * (t.b_y - t.ay)) < 0"
WIND = f"CASE WHEN ay <= {MIDDLE[1]!r} AND b_y > {MIDDLE[1]!r} AND (bx - ax) * ({MIDDLE[1]!r} - ay) > ({MIDDLE[0]!r} - ax) * (b_y - ay) THEN 1 WHEN ay > {MIDDLE[1]!r} AND b_y <= {MIDDLE[1]!r} AND (bx - ax) * ({MIDDLE[1]!r} - ay) < ({MIDDLE[0]!r} - ax) * (b_y - ay) THEN -1 ELSE 0 END"
MID = lambda: S.point(*MIDDLE)
HALF = "q.i < 8"
FLAT = "sqrt(pow(p.x - (s.ax + t * (s.bx - s.ax)), 2) + pow(p.y - (s.ay + t * (s.b_y - s.ay)), 2))"
FOOT = "CASE WHEN s.ax = s.bx AND s.ay = s.b_y THEN 0.0 ELSE least(1.0, greatest(0.0, ((p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.b_y - s.ay)) / (pow(s.bx - s.ax, 2) + pow(s.b_y - s.ay, 2)))) END"


def one_way(points: str, segs: str) -> str:
    return f"SELECT shape, max(d) AS d FROM (SELECT shape, i, min({FLAT.replace('s.', 'u.').replace('p.', 'u.p')}) AS d FROM (SELECT p.shape, p.i, p.x AS px, p.y AS py, s.ax, s.ay, s.bx, s.b_y, {FOOT} AS t FROM q p JOIN seg s ON s.shape = p.shape WHERE {points} AND {segs}) u GROUP BY shape, i) z GROUP BY shape"


TILE = 0.004
TILE_IN = """NOT ((bx = ax AND (x0 > ax OR x1 <= ax)) OR (b_y = ay AND (y0 > ay OR y1 <= ay)))
 AND greatest(0.0, CASE WHEN bx = ax THEN 0.0 ELSE least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN 0.0 ELSE least((y0 - ay) / (b_y - ay), (y1 - ay) / (b_y - ay)) END)
  <= least(1.0, CASE WHEN bx = ax THEN 1.0 ELSE greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN 1.0 ELSE greatest((y0 - ay) / (b_y - ay), (y1 - ay) / (b_y - ay)) END)"""

PROGRAMS = {
    # GEO1, AGG6
    "shape_length": (partial(over_shapes, columns=lambda p: [whole(S.length(p), 1000).alias("mm")]), f"{SEG} SELECT shape, {fix('sum(m)', '1000')} AS mm FROM seg GROUP BY shape"),
    # GEO3, AGG4
    "shape_curvature": (
        partial(over_shapes, columns=lambda p: [whole(S.curvature(p), 1e6).alias("score")]),
        f"{SEG}, t AS (SELECT a.shape, a.m AS a, b.m AS b, {dist('c', 'd')} AS c FROM seg a JOIN seg b ON b.shape = a.shape AND b.i = a.i + 1 JOIN q c ON c.shape = a.shape AND c.i = a.i JOIN q d ON d.shape = a.shape AND d.i = a.i + 2), k AS (SELECT *, (a + b + c) / 2 AS h FROM t), s AS (SELECT shape, h * (h - a) * (h - b) * (h - c) AS sq, a * b * c AS abc FROM k) SELECT shape, {fix('avg(CASE WHEN sq > 0 THEN least(15.0, 1500 * 4 * sqrt(sq) / abc) ELSE 0.0 END)', '1e6')} AS score FROM s GROUP BY shape",
    ),
    # GEO4
    "point_along_segments": (
        partial(each, items=lambda p: S.segments(p), columns=lambda s: [whole(S.along(s["a"], s["b"], F.lit(0.3))[c], 1e7).alias(c) for c in "xy"]),
        f"{RUN}, {at_metres('spot', 'SELECT shape, i AS k, before + 0.3 * m AS d FROM run')}, z AS (SELECT s.shape, s.i, CASE WHEN s.ax = s.bx AND s.ay = s.b_y THEN s.ax END AS sx, s.ay AS sy FROM seg s) SELECT spot.shape, CAST(spot.k AS BIGINT) AS k, {fix('coalesce(sx, spot.x)', '1e7')} AS x, {fix('CASE WHEN sx IS NULL THEN spot.y ELSE sy END', '1e7')} AS y FROM spot JOIN z ON z.shape = spot.shape AND z.i = spot.k",
    ),
    # GEO5, GEO6, SNP2
    "project_on_shape": (
        partial(over_shapes, columns=lambda p: [S.let(S.snapped(MID(), p), lambda s: F.struct(whole(s["distance"], 1000).alias("mm"), s["segment"].cast("long").alias("segment"), whole(S.percent_along(p, s), 1e6).alias("percent"))).alias("s")]),
        f"{SEG}, {near(MIDDLE)}, best AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY d, i) AS rn, sum(m) OVER (PARTITION BY shape ORDER BY i) - m AS before, sum(m) OVER (PARTITION BY shape) AS total FROM pd) SELECT shape, {fix('d', '1000')} AS mm, CAST(i AS BIGINT) AS segment, {fix('(before + t * m) / total', '1e6')} AS percent FROM best WHERE rn = 1",
    ),
    # GEO7, GEO8, JON10
    "point_in_shape": (
        partial(over_shapes, columns=lambda p: [S.winding(MID(), p).cast("long").alias("winding"), S.even_odd(MID(), p).cast("int").alias("odd")]),
        f"{RING} SELECT shape, CAST(sum({WIND}) AS BIGINT) AS winding, CAST(sum(CASE WHEN (ay > {MIDDLE[1]!r}) <> (b_y > {MIDDLE[1]!r}) AND {MIDDLE[0]!r} < (bx - ax) * ({MIDDLE[1]!r} - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END) % 2 AS INT) AS odd FROM seg GROUP BY shape",
    ),
    # GEO9
    "shape_area": (partial(over_shapes, columns=lambda p: [whole(S.area(p) + 0.25e-12, 1e9).alias("area")]), f"{RING} SELECT shape, {fix('(sum((bx - ax) * (b_y + ay)) * -0.5 + 0.25e-12)', '1e9')} AS area FROM seg GROUP BY shape"),
    # GEO15
    "hausdorff_halves": (
        partial(over_shapes, columns=lambda p: [whole(F.when(F.size(p) >= 10, S.hausdorff(F.slice(p, 1, 8), F.slice(p, 9, F.greatest(F.size(p) - 8, F.lit(0))))), 1e7).alias("far")]),
        f"{SEG}, f AS ({one_way('p.i < 8', 's.i >= 8')}), b AS ({one_way('p.i >= 8', 's.i < 7')}) SELECT n.shape, CASE WHEN n.last >= 9 THEN {fix('greatest(f.d, b.d)', '1e7')} END AS far FROM n LEFT JOIN f ON f.shape = n.shape LEFT JOIN b ON b.shape = n.shape",
    ),
    # GEO16, GEO19
    "self_crossings": (
        partial(each, items=lambda p: S.self_crossings(p), columns=lambda c: [c["i"].cast("long").alias("i"), c["j"].cast("long").alias("j"), whole(c["point"]["x"], 1e7).alias("x")]),
        f"{SEG} SELECT s.shape, row_number() OVER (PARTITION BY s.shape ORDER BY s.i, t.i) - 1 AS k, CAST(s.i AS BIGINT) AS i, CAST(t.i AS BIGINT) AS j, {fix('s.ax + ((t.ax - s.ax) * (t.b_y - t.ay) - (t.ay - s.ay) * (t.bx - t.ax)) / ((s.bx - s.ax) * (t.b_y - t.ay) - (s.b_y - s.ay) * (t.bx - t.ax)) * (s.bx - s.ax)', '1e7')} AS x FROM seg s JOIN seg t ON t.shape = s.shape AND t.i > s.i + 1 WHERE {CROSS}",
    ),
    # GEO17
    "clip_to_box": (
        partial(over_shapes, columns=lambda p: [S.let(S.clipped(p, *BOX), lambda c: F.struct(F.size(c).cast("long").alias("n"), whole(S.total(F.transform(c, lambda q, i: q["x"] * (i + 1) + q["y"])), 1e6).alias("digest"))).alias("s")]),
        f"{Q}, {clip_sql()} SELECT n.shape, count(c3.i) AS n, {fix('coalesce(sum(c3.x * c3.i + c3.y), 0)', '1e6')} AS digest FROM n LEFT JOIN c3 ON c3.shape = n.shape GROUP BY n.shape",
    ),
    # GEO20
    "resample_shape": (
        partial(each, items=lambda p: S.resampled(p, F.lit(700.0)), columns=lambda q: [whole(q[c], 1e6).alias(c) for c in "xy"]),
        f"{RUN}, t AS (SELECT DISTINCT shape, total FROM run), w AS (SELECT shape, CAST(unnest(range(0, CAST(floor(total / 700.0) AS BIGINT) + 1)) AS BIGINT) AS k FROM t), {at_metres('spot', 'SELECT shape, k, k * 700.0 AS d FROM w')} SELECT shape, CAST(k AS BIGINT) AS k, {fix('x', '1e6')} AS x, {fix('y', '1e6')} AS y FROM spot UNION ALL SELECT q.shape, CAST(floor(t.total / 700.0) AS BIGINT) + 1, {fix('q.x', '1e6')}, {fix('q.y', '1e6')} FROM q JOIN n ON n.shape = q.shape AND q.i = n.last JOIN t ON t.shape = q.shape",
    ),
    # GEO21, CST14
    "trim_shape": (
        partial(over_shapes, columns=lambda p: [S.let(S.trimmed(p, F.lit(0.25), F.lit(0.7)), lambda t: F.struct(F.size(t).cast("long").alias("n"), whole(t[0]["x"], 1e6).alias("x0"), whole(F.element_at(t, -1)["y"], 1e6).alias("y1"))).alias("s")]),
        f"{RUN}, t AS (SELECT DISTINCT shape, total FROM run), {at_metres('spot', 'SELECT shape, 0 AS k, total * 0.25 AS d FROM t UNION ALL SELECT shape, 1, total * 0.7 FROM t')}, c AS (SELECT shape, count(*) AS n FROM (SELECT shape, before AS d, total FROM run UNION ALL SELECT shape, total, total FROM t) b WHERE d > total * 0.25 AND d < total * 0.7 GROUP BY shape) SELECT a.shape, coalesce(c.n, 0) + 2 AS n, {fix('a.x', '1e6')} AS x0, {fix('b.y', '1e6')} AS y1 FROM spot a JOIN spot b ON b.shape = a.shape AND a.k = 0 AND b.k = 1 LEFT JOIN c ON c.shape = a.shape",
    ),
    # GEO22, GEO23
    "shape_headings": (
        partial(over_shapes, columns=lambda p: [(whole(S.heading_along(p, F.lit(400.0)), 100) % 36000).alias("along"), (whole(S.tangent(p, F.lit(1), 200.0), 100) % 36000).alias("tangent")]),
        f"{RUN}, w AS (SELECT shape, 0 AS k, 400.0 AS d FROM run WHERE i = 0 UNION ALL SELECT shape, 1, greatest(0.0, before - 200.0) FROM run WHERE i = 1 UNION ALL SELECT shape, 2, before + 200.0 FROM run WHERE i = 1), {at_metres('spot', 'SELECT * FROM w')} SELECT a.shape, {fix(bear('o', 'a'), '100')} % 36000 AS along, {fix(bear('b', 'c'), '100')} % 36000 AS tangent FROM spot a JOIN spot b ON b.shape = a.shape AND b.k = 1 JOIN spot c ON c.shape = a.shape AND c.k = 2 JOIN q o ON o.shape = a.shape AND o.i = 0 WHERE a.k = 0",
    ),
    # GEO28
    "tiles_along_shape": (
        lambda spark, sf: shapes(spark, sf).select("shape", F.explode(S.tiles_of(F.col("pts"), TILE)).alias("t")).select("shape", F.col("t.row").alias("row"), F.col("t.col").alias("col")),
        f"{SEG}, s AS (SELECT *, CAST(floor((least(ay, b_y) + 90) / {TILE}E0) AS BIGINT) AS r0, CAST(floor((greatest(ay, b_y) + 90) / {TILE}E0) AS BIGINT) AS r1, CAST(floor((least(ax, bx) + 180) / {TILE}E0) AS BIGINT) AS c0, CAST(floor((greatest(ax, bx) + 180) / {TILE}E0) AS BIGINT) AS c1 FROM seg), r AS (SELECT *, unnest(range(r0, r1 + 1)) AS rw FROM s), c AS (SELECT *, unnest(range(c0, c1 + 1)) AS cl FROM r), b AS (SELECT *, -180 + cl * {TILE}E0 AS x0, -180 + (cl + 1) * {TILE}E0 AS x1, -90 + rw * {TILE}E0 AS y0, -90 + (rw + 1) * {TILE}E0 AS y1 FROM c) SELECT DISTINCT shape, rw AS row, cl AS col FROM b WHERE {TILE_IN}",
    ),
    # GEO32: sides of occupied cells that no neighbour shares
    "region_boundary": (
        lambda spark, sf: _boundary(shapes(spark, sf)),
        f"{Q}, c AS (SELECT DISTINCT CAST(floor(shape / 1000000) AS BIGINT) % 10 AS region, CAST(floor(x / 0.002) AS BIGINT) AS cx, CAST(floor(y / 0.002) AS BIGINT) AS cy FROM q) SELECT region, count(*) AS cells, CAST(sum(4 - (SELECT count(*) FROM c o WHERE o.region = c.region AND abs(o.cx - c.cx) + abs(o.cy - c.cy) = 1)) AS BIGINT) AS sides FROM c GROUP BY region",
    ),
    # GEO30
    "normalised_headings": (
        lambda spark, sf: derive.run(spark, sf, f"WITH {POINTS} SELECT shape, i, x, y FROM p").select("shape", "i", whole(S.circular(F.col("x") * 1000, -180, 180), 1000).alias("lon"), whole(F.greatest(F.lit(-85.0), F.least(F.lit(51.99), F.col("y") - 0.02)), 1000).alias("lat")),
        f"WITH {POINTS} SELECT shape, i, {fix('x * 1000 + 180 - 360 * floor((x * 1000 + 180) / 360) - 180', '1000')} AS lon, {fix('CASE WHEN y - 0.02 > 51.99 THEN 51.99 WHEN y - 0.02 < -85 THEN -85.0 ELSE y - 0.02 END', '1000')} AS lat FROM p",
    ),
}


def _boundary(found: DataFrame) -> DataFrame:
    p = found.select((F.floor(F.col("shape") / 1000000) % 10).alias("region"), F.explode("pts").alias("p"))
    cells = p.select("region", F.floor(F.col("p.x") / 0.002).alias("cx"), F.floor(F.col("p.y") / 0.002).alias("cy")).distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    sides = cells.withColumn("s", steps).select("region", "cx", "cy", (F.col("cx") + F.col("s.dx")).alias("ox"), (F.col("cy") + F.col("s.dy")).alias("oy"))
    other = cells.select("region", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.lit(1).alias("hit"))
    open_sides = sides.join(other, ["region", "ox", "oy"], "left")
    return open_sides.groupBy("region").agg((F.count("*") / 4).cast("long").alias("cells"), F.count_if(F.col("hit").isNull()).alias("sides"))


def flat(function, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct of results becomes columns."""
    found = function(spark, sf_dir)
    return found.select("shape", "s.*") if "s" in found.columns else found


def simplify(spark: SparkSession, sf_dir: str, tolerance: float = 0.003) -> DataFrame:  # GEO14; tested against the definition
    def run(batches):
        for pdf in batches:
            kept = [S.simplified(np.array([(q["x"], q["y"]) for q in pts]), tolerance) for pts in pdf["pts"]]
            yield pdf.assign(kept=kept)[["shape", "kept"]]

    return shapes(spark, sf_dir).mapInPandas(run, "shape long, kept array<long>")


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:  # GEO24, SNP4
    def run(batches):
        for pdf in batches:
            found = [S.bounding_circle(np.array([(q["x"], q["y"]) for q in pts])) for pts in pdf["pts"]]
            yield pdf.assign(x=[f[0] for f in found], y=[f[1] for f in found], r=[f[2] for f in found])[["shape", "x", "y", "r"]]

    found = shapes(spark, sf_dir).mapInPandas(run, "shape long, x double, y double, r double")
    return found.select("shape", whole(F.col("r"), 1e8).alias("radius"))


#: Every circle through two or three points that holds all points; the least is the bounding circle.
CIRCLES = f"""{Q}, two AS (SELECT a.shape, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, a.x AS px, a.y AS py FROM q a JOIN q b ON b.shape = a.shape AND b.i >= a.i),
 t AS (SELECT a.shape, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS b_y, c.x - a.x AS ex, c.y - a.y AS ey FROM q a JOIN q b ON b.shape = a.shape AND b.i > a.i JOIN q c ON c.shape = a.shape AND c.i > b.i),
 three AS (SELECT shape, ax + (ey * (bx * bx + b_y * b_y) - b_y * (ex * ex + ey * ey)) / (2 * (bx * ey - b_y * ex)) AS cx, ay + (bx * (ex * ex + ey * ey) - ex * (bx * bx + b_y * b_y)) / (2 * (bx * ey - b_y * ex)) AS cy, ax AS px, ay AS py FROM t WHERE abs(bx * ey - b_y * ex) > 1e-15),
 every AS (SELECT shape, cx, cy, sqrt(pow(cx - px, 2) + pow(cy - py, 2)) AS r FROM (SELECT * FROM two UNION ALL SELECT * FROM three) u),
 far AS (SELECT e.shape, e.cx, e.cy, e.r, max(sqrt(pow(e.cx - q.x, 2) + pow(e.cy - q.y, 2))) AS d FROM every e JOIN q ON q.shape = e.shape GROUP BY e.shape, e.cx, e.cy, e.r)
 SELECT shape, {fix('min(r)', '1e8')} AS radius FROM far WHERE d <= r + 1e-12 GROUP BY shape"""

QUERIES = {name: partial(flat, f) for name, (f, _) in PROGRAMS.items()} | {"simplify_shape": simplify, "bounding_circle": circles}
ORACLES = {name: sql for name, (_, sql) in PROGRAMS.items()} | {"bounding_circle": CIRCLES}
