"""Searches over edges with turn costs and restrictions, paths, isochrones, mode changes and timetables, and their DuckDB twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import codecs
from roadweave.operators import paths
from roadweave.operators.search import converge, cut, widening
from roadweave.plans import derive
from roadweave.plans.catalog import DEPOTS
from roadweave.plans.derive import DEPARTURES, EDGES, NODES, idiv

#: From one edge to the next: no U-turn, no forbidden turn; a turn costs 500 to 2500 ms more with the density of the place.
TURNS = f"""turns AS (SELECT a.eid AS u, b.eid AS v, b.cost_ms + CASE WHEN a.heading = b.heading THEN 500 WHEN (b.heading - a.heading + 360) % 360 = 90 THEN 1000 ELSE 2500 END * (1 + {idiv('a.density', 4)}) AS w
 FROM edges a JOIN edges b ON a.v = b.u WHERE a.u <> b.v AND (a.eid * 31 + b.eid * 17) % 23 <> 0)"""
#: An origin is a node of its own beside the edges, so that partial first edges and several starts need no special case.
ORIGINS = f"SELECT -1 - src AS src, -1 - src AS node FROM ({DEPOTS}) d"
ARCS = f"SELECT u, v, w FROM turns UNION ALL SELECT -1 - d.src, e.eid, e.cost_ms FROM ({DEPOTS}) d JOIN edges e ON e.u = d.src"
#: Legs of one tour through all depots in order, each to every edge that ends at the next depot.
LEGS = f"SELECT src, lead(src) OVER (ORDER BY src) AS nxt FROM ({DEPOTS}) d"
GOALS = f"SELECT -1 - l.src AS src, e.eid AS dst FROM ({LEGS}) l JOIN edges e ON e.v = l.nxt"


def edge_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.run(spark, sf_dir, f"WITH {EDGES}, {TURNS} {ARCS}")


def edge_labels(spark: SparkSession, sf_dir: str, arcs: DataFrame, limit: int | None) -> DataFrame:
    return cut(converge(derive.run(spark, sf_dir, f"WITH {NODES} {ORIGINS}"), arcs, limit=limit), "labels")


def legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges of the best path of each leg, its goal); the search widens until each leg has a goal within the limit or has no limit."""
    arcs = cut(edge_arcs(spark, sf_dir), "arcs")
    goals = cut(derive.run(spark, sf_dir, f"WITH {EDGES} {GOALS}"), "goals")
    asked = goals.select("src").distinct().count()
    reached = lambda labels: goals.join(labels.withColumnRenamed("node", "dst"), ["src", "dst"])
    labels = widening(lambda limit: edge_labels(spark, sf_dir, arcs, limit), lambda found, _: reached(found).select("src").distinct().count() == asked)
    best = reached(labels).groupBy("src").agg(F.min_by(F.struct("dst", "cost"), F.struct("cost", "dist", "dst")).alias("best"))
    best = cut(best.select("src", "best.*"), "best")
    # a path has no label above its goal's
    labels = cut(labels.join(best.select("src", F.col("cost").alias("most")), "src").where("cost <= most").drop("most"), "labels")
    best = best.select("src", "dst")
    return paths.paths(labels, arcs, best), best


def route_path(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF1, GRF2, GRF3, GRF21, FLT5, CST2, GRF25
    found, _ = legs(spark, sf_dir)
    return found.where("node >= 0").select((-1 - F.col("src")).alias("origin"), "dist", F.col("node").alias("eid"), F.col("cost").alias("elapsed"))


def route_json(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK8, SNK9, AGG15, GRF25, EXT9
    """A leg as JSON with its shape as an encoded polyline, and its summary."""
    found, _ = legs(spark, sf_dir)
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid AS node, lon_u, lat_u, lon_v, lat_v, length_m, toll FROM edges")
    rows = found.where("node >= 0").join(edges, "node")
    pts = F.array_sort(F.collect_list(F.struct("dist", F.struct(F.col("lon_v").alias("x"), F.col("lat_v").alias("y")).alias("p"))))
    first = F.min_by(F.struct(F.col("lon_u").alias("x"), F.col("lat_u").alias("y")), "dist")
    leg = rows.groupBy("src").agg(F.max("cost").alias("time"), F.sum("length_m").alias("length"), F.max("toll").alias("has_toll"), F.concat(F.array(first), F.transform(pts, lambda q: q["p"])).alias("pts"), F.count("*").alias("edges"))
    summary = F.struct(F.col("time"), F.col("length"), F.col("has_toll").cast("int").alias("has_toll"))
    return leg.select((-1 - F.col("src")).alias("origin"), F.col("edges"), F.to_json(F.struct(summary.alias("summary"), codecs.encode_polyline(F.col("pts"), 6).alias("shape"))).alias("leg"))


def _keyed(name: str, seeds: str, arcs: str) -> str:
    return f"""{name}(src, node, cost, dist) USING KEY (src, node) AS (SELECT src, node, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({seeds}) s
  UNION SELECT x.src, x.node, x.p.c, x.p.d FROM (SELECT l.src, e.v AS node, min({{'c': l.cost + e.w, 'd': l.dist + 1}}) AS p FROM {name} l JOIN ({arcs}) e ON e.u = l.node GROUP BY l.src, e.v) x
  LEFT JOIN recurring.{name} o ON o.src = x.src AND o.node = x.node WHERE o.cost IS NULL OR x.p.c < o.cost OR (x.p.c = o.cost AND x.p.d < o.dist))"""


_SEARCH = f"WITH RECURSIVE {EDGES}, {TURNS}, arcs AS MATERIALIZED ({ARCS}), {_keyed('l', ORIGINS, 'SELECT * FROM arcs')}, lab AS MATERIALIZED (SELECT * FROM l)"
_BACK = f"""{_SEARCH}, goal AS (SELECT src, dst FROM (SELECT g.src, g.dst, row_number() OVER (PARTITION BY g.src ORDER BY lab.cost, lab.dist, g.dst) AS rn FROM ({GOALS}) g JOIN lab ON lab.src = g.src AND lab.node = g.dst) k WHERE rn = 1),
 pred AS MATERIALIZED (SELECT b.src, b.node, min(a.node) AS pred FROM lab b JOIN arcs e ON e.v = b.node JOIN lab a ON a.src = b.src AND a.node = e.u AND a.cost + e.w = b.cost AND a.dist + 1 = b.dist GROUP BY b.src, b.node),
 walk(src, node) AS (SELECT src, dst FROM goal UNION ALL SELECT w.src, p.pred FROM walk w JOIN pred p ON p.src = w.src AND p.node = w.node)"""
ROUTE_SQL = f"{_BACK} SELECT -1 - w.src AS origin, lab.dist, w.node AS eid, lab.cost AS elapsed FROM walk w JOIN lab ON lab.src = w.src AND lab.node = w.node WHERE w.node >= 0"


def _zigzag(a: str) -> str:
    return f"CASE WHEN {a} < 0 THEN -2 * ({a}) - 1 ELSE 2 * ({a}) END"


ROUTE_JSON_SQL = f"""{_BACK}, e AS (SELECT -1 - w.src AS origin, lab.dist, lab.cost, x.* FROM walk w JOIN lab ON lab.src = w.src AND lab.node = w.node JOIN edges x ON x.eid = w.node),
 pt AS (SELECT origin, dist AS i, CAST(round(lat_v * 1e6) AS BIGINT) AS y, CAST(round(lon_v * 1e6) AS BIGINT) AS x FROM e UNION ALL SELECT origin, 0, CAST(round(lat_u * 1e6) AS BIGINT), CAST(round(lon_u * 1e6) AS BIGINT) FROM e WHERE dist = 1),
 df AS (SELECT origin, i, y - coalesce(lag(y) OVER w, 0) AS dy, x - coalesce(lag(x) OVER w, 0) AS dx FROM pt WINDOW w AS (PARTITION BY origin ORDER BY i)),
 z AS (SELECT origin, i, 0 AS axis, {_zigzag('dy')} AS n FROM df UNION ALL SELECT origin, i, 1, {_zigzag('dx')} FROM df),
 ch AS (SELECT origin, string_agg(chr(CAST(((n >> (5 * k)) & 31) + 63 + CASE WHEN (n >> (5 * (k + 1))) > 0 THEN 32 ELSE 0 END AS INTEGER)), '' ORDER BY i, axis, k) AS shape FROM z, range(0, 9) t(k) WHERE k = 0 OR (n >> (5 * k)) > 0 GROUP BY origin)
 SELECT e.origin, count(*) AS edges, '{{"summary":{{"time":' || max(cost) || ',"length":' || CAST(sum(length_m) AS BIGINT) || ',"has_toll":' || max(toll) || '}},"shape":' || to_json(any_value(ch.shape)) || '}}' AS leg FROM e JOIN ch ON ch.origin = e.origin GROUP BY e.origin"""


LIMIT_MS, CELL = 400_000, 5


def isochrone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF11, AGG2, JON14
    """Least time and way to any edge's end in each cell of 5 x 5 nodes, from every depot, within a limit of time."""
    labels = edge_labels(spark, sf_dir, edge_arcs(spark, sf_dir), LIMIT_MS)
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid AS node, v FROM edges")
    found = labels.where((F.col("node") >= 0) & (F.col("cost") <= LIMIT_MS)).join(edges, "node")
    cell = found.groupBy((-1 - F.col("src")).alias("origin"), F.floor(F.col("v") / (50 * CELL)).alias("row"), F.floor(F.col("v") % 50 / CELL).alias("col"))
    return cell.agg(F.min("cost").alias("ms"), (F.min("dist") * 100).alias("metres"))


CELLS_SQL = f"{_SEARCH} SELECT -1 - lab.src AS origin, {idiv('e.v', 50 * CELL)} AS row, {idiv('e.v % 50', CELL)} AS col, min(cost) AS ms, min(dist) * 100 AS metres FROM lab JOIN edges e ON e.eid = lab.node WHERE cost <= {LIMIT_MS} GROUP BY ALL"


def expansion_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK13, GRF16, EXT4
    """Every edge that a search within the limit settled, as a GeoJSON feature."""
    labels = edge_labels(spark, sf_dir, edge_arcs(spark, sf_dir), LIMIT_MS)
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid AS node, u, v FROM edges")
    found = labels.where((F.col("node") >= 0) & (F.col("cost") <= LIMIT_MS)).join(edges, "node")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("node").alias("edge_id"), F.col("cost").alias("duration"), (F.col("dist") * 100).alias("distance"), F.lit("s").alias("edge_status")).alias("properties"))
    return found.select((-1 - F.col("src")).alias("origin"), F.col("node").alias("eid"), F.to_json(feature).alias("feature"))


EXPANSION_SQL = f"""{_SEARCH} SELECT -1 - src AS origin, node AS eid, to_json({{'type': 'Feature', 'properties': {{'edge_id': node, 'duration': cost, 'distance': dist * 100, 'edge_status': 's'}}}})::VARCHAR AS feature FROM lab WHERE node >= 0 AND cost <= {LIMIT_MS}"""

#: Walking and cycling as two layers of nodes; bikes are taken and left at stations.
BIKE_ARCS = "SELECT u * 2 AS u, v * 2 AS v, cost_ms * 4 AS w FROM edges UNION ALL SELECT u * 2 + 1, v * 2 + 1, cost_ms + 500 * grade FROM edges UNION ALL SELECT gid * 2, gid * 2 + 1, 120000 FROM nodes WHERE node_type = 3 UNION ALL SELECT gid * 2 + 1, gid * 2, 60000 FROM nodes WHERE node_type = 3"
BIKE_SEEDS = f"SELECT src * 2 AS src, node * 2 AS node FROM ({DEPOTS}) d"


def bike_share(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF9, GRF19, ETL16
    arcs = derive.run(spark, sf_dir, f"WITH {EDGES} {BIKE_ARCS}")
    found = converge(derive.run(spark, sf_dir, f"WITH {NODES} {BIKE_SEEDS}"), arcs).where("node % 2 = 0")
    return found.select((F.col("src") / 2).cast("long").alias("src"), (F.col("node") / 2).cast("long").alias("node"), "cost")


BIKE_SQL = f"WITH RECURSIVE {EDGES}, arcs AS MATERIALIZED ({BIKE_ARCS}), {_keyed('l', BIKE_SEEDS, 'SELECT * FROM arcs')} SELECT src // 2 AS src, node // 2 AS node, cost FROM l WHERE node % 2 = 0"

#: A trip's next stop, where the timetable runs forward.
CONNECTIONS = f"{DEPARTURES}, k AS (SELECT stop AS a, dep, lead(stop) OVER w AS b, lead(dep) OVER w AS arr FROM departures WINDOW w AS (PARTITION BY trip ORDER BY seq, dep, stop, line_id)), conn AS (SELECT * FROM k WHERE b IS NOT NULL AND arr > dep)"


def transit_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF18, JON11, ETL15
    conn = derive.run(spark, sf_dir, f"WITH {CONNECTIONS} SELECT * FROM conn")
    starts = derive.run(spark, sf_dir, f"WITH {NODES} SELECT src, src AS stop, CAST(14400 AS BIGINT) AS at FROM ({DEPOTS}) d")
    return paths.arrivals(starts, conn).select("src", "stop", "at")


TRANSIT_SQL = f"""WITH RECURSIVE {NODES}, {CONNECTIONS}, arcs AS MATERIALIZED (SELECT * FROM conn), l(src, stop, tm) USING KEY (src, stop) AS (SELECT src, src, CAST(14400 AS BIGINT) FROM ({DEPOTS}) d
 UNION SELECT x.src, x.b, x.arr FROM (SELECT l.src, c.b, min(c.arr) AS arr FROM l JOIN arcs c ON c.a = l.stop AND c.dep >= l.tm GROUP BY l.src, c.b) x LEFT JOIN recurring.l o ON o.src = x.src AND o.stop = x.b WHERE o.tm IS NULL OR x.arr < o.tm)
 SELECT src, stop, tm AS at FROM l"""

#: Streets with some links taken out fall apart.
LINKS = "SELECT u, v FROM edges WHERE dir < 2 AND (u * 7 + v * 11) % 5 < 2"


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF26, SNK20
    return cut(paths.components(derive.run(spark, sf_dir, f"WITH {EDGES} {LINKS}")), "components")


LINKED_SQL = f"""WITH RECURSIVE {EDGES}, both_ways AS MATERIALIZED (SELECT u, v FROM ({LINKS}) a UNION SELECT v, u FROM ({LINKS}) b), l(node, c) USING KEY (node) AS (SELECT DISTINCT u, u FROM both_ways
 UNION SELECT x.v, x.c FROM (SELECT e.v, min(l.c) AS c FROM l JOIN both_ways e ON e.u = l.node GROUP BY e.v) x JOIN recurring.l o ON o.node = x.v WHERE x.c < o.c) SELECT node, c AS component FROM l"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF27, GRF28, ETL13
    """Maximal chains of links whose inner nodes have just two: each chain's number of links, least and greatest node."""
    links = cut(derive.run(spark, sf_dir, f"WITH {EDGES} {LINKS}"), "links")
    ends = links.select(F.col("u").alias("node"), "u", "v").unionByName(links.select(F.col("v").alias("node"), "u", "v"))
    name = (F.col("u") * 100_000_000 + F.col("v")).alias("id")
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).where("n = 2")
    joined = paths.components(inner.select(F.col("first").alias("u"), F.col("last").alias("v")))
    named = links.withColumn("id", name).join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("chain", F.coalesce("component", "id"))
    return named.groupBy("chain").agg(F.count("*").alias("links"), F.least(F.min("u"), F.min("v")).alias("low"), F.greatest(F.max("u"), F.max("v")).alias("high"))


CHAINS_SQL = f"""WITH RECURSIVE {EDGES}, k AS MATERIALIZED (SELECT u, v, u * 100000000 + v AS id FROM ({LINKS}) a), e AS (SELECT u AS node, id FROM k UNION ALL SELECT v, id FROM k), two AS (SELECT node FROM e GROUP BY node HAVING count(*) = 2),
 j AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.node = b.node AND a.id <> b.id JOIN two ON two.node = a.node), l(id, c) USING KEY (id) AS (SELECT id, id FROM k
 UNION SELECT x.y, x.c FROM (SELECT j.y, min(l.c) AS c FROM l JOIN j ON j.x = l.id GROUP BY j.y) x JOIN recurring.l o ON o.id = x.y WHERE x.c < o.c)
 SELECT l.c AS chain, count(*) AS links, min(least(k.u, k.v)) AS low, max(greatest(k.u, k.v)) AS high FROM l JOIN k ON k.id = l.id GROUP BY l.c"""

#: Triangles of a 2 x 2 block of nodes around its centre; where a level passes between corners a line crosses the triangle.
LEVEL = 200_000


def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF12, SRT7
    """The pieces of the line of equal time from every depot: per block and triangle its two ends, in node units."""
    nodes = derive.run(spark, sf_dir, f"WITH {NODES} SELECT gid, r, c FROM nodes")
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT u, v, cost_ms AS w FROM edges")
    seeds = derive.run(spark, sf_dir, f"WITH {NODES} {DEPOTS}")
    # a block whose corners all are at LEVEL or beyond has no line; in one that has, no corner is more than two edges from an earlier one
    limit = LEVEL + 2 * (edges.agg(F.max("w")).first()[0] or 0)
    times = cut(converge(seeds, edges, limit=limit).select("src", F.col("node").alias("gid"), "cost").join(nodes, "gid").select("src", "r", "c", F.col("cost").cast("double").alias("t")), "times")
    corner = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0)))))
    blocks = times.withColumn("k", corner).groupBy("src", (F.col("r") - F.col("k.dr")).alias("r"), (F.col("c") - F.col("k.dc")).alias("c"))
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("k.dr") == 0, F.col("k.dc")).otherwise(3 - F.col("k.dc")).alias("o"), "t", F.col("k.dc").cast("double").alias("x"), F.col("k.dr").cast("double").alias("y")))).alias("q")).where(F.size("q") == 4)
    middle = F.struct(F.lit(9).alias("o"), (F.aggregate("q", F.lit(0.0), lambda s, p: s + p["t"]) / 4).alias("t"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    triangles = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(F.col("q"), i), F.get(F.col("q"), (i + 1) % 4), F.col("m")))
    rows = blocks.withColumn("m", middle).select("src", "r", "c", F.posexplode(triangles).alias("tri", "p"))

    def cross(a, b):
        share = (LEVEL - a["t"]) / (b["t"] - a["t"])
        return F.when((a["t"] < LEVEL) != (b["t"] < LEVEL), F.struct((F.col("c") + a["x"] + share * (b["x"] - a["x"])).alias("x"), (F.col("r") + a["y"] + share * (b["y"] - a["y"])).alias("y")))

    p = [F.col("p")[k] for k in range(3)]
    ends = F.filter(F.array(cross(p[0], p[1]), cross(p[1], p[2]), cross(p[2], p[0])), lambda e: e.isNotNull())
    found = rows.withColumn("e", ends).where(F.size("e") == 2)
    at = lambda k, axis: F.floor(F.get(F.col("e"), F.lit(k))[axis] * 1e6 + 0.5).cast("long")
    return found.select("src", "r", "c", F.col("tri").cast("long").alias("tri"), at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1"))


def _cross_sql(a: str, b: str, axis: str) -> str:
    return f"CASE WHEN (t{a} < {LEVEL}) <> (t{b} < {LEVEL}) THEN floor(({'c' if axis == 'x' else 'r'} + {axis}{a} + ({LEVEL} - t{a}) / (t{b} - t{a}) * ({axis}{b} - {axis}{a})) * 1e6 + 0.5) END"


def contour_sql() -> str:
    corners = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))
    quad = "SELECT a.src, a.r, a.c, a.t AS q0, b.t AS q1, d.t AS q2, e.t AS q3, (a.t + b.t + d.t + e.t) / 4 AS tm FROM g a JOIN g b ON b.src = a.src AND b.r = a.r AND b.c = a.c + 1 JOIN g d ON d.src = a.src AND d.r = a.r + 1 AND d.c = a.c + 1 JOIN g e ON e.src = a.src AND e.r = a.r + 1 AND e.c = a.c"
    tris = " UNION ALL ".join(f"SELECT src, r, c, {i} AS tri, q{i} AS ta, q{(i + 1) % 4} AS tb, tm, {corners[i][0]}::DOUBLE AS xa, {corners[i][1]}::DOUBLE AS ya, {corners[(i + 1) % 4][0]}::DOUBLE AS xb, {corners[(i + 1) % 4][1]}::DOUBLE AS yb, 0.5::DOUBLE AS xm, 0.5::DOUBLE AS ym FROM quad" for i in range(4))
    cuts = ", ".join(f"[{_cross_sql('a', 'b', x)}, {_cross_sql('b', 'm', x)}, {_cross_sql('m', 'a', x)}] AS {x}s" for x in "xy")
    return f"""WITH RECURSIVE {EDGES}, {_keyed('l', DEPOTS, 'SELECT u, v, cost_ms AS w FROM edges')}, g AS MATERIALIZED (SELECT l.src, n.r, n.c, CAST(l.cost AS DOUBLE) AS t FROM l JOIN nodes n ON n.gid = l.node), quad AS ({quad}), tri AS ({tris}),
 lines AS (SELECT src, r, c, tri, {cuts} FROM tri), f AS (SELECT src, r, c, tri, list_filter(xs, lambda v: v IS NOT NULL) AS xs, list_filter(ys, lambda v: v IS NOT NULL) AS ys FROM lines)
 SELECT src, r, c, CAST(tri AS BIGINT) AS tri, CAST(xs[1] AS BIGINT) AS x0, CAST(ys[1] AS BIGINT) AS y0, CAST(xs[2] AS BIGINT) AS x1, CAST(ys[2] AS BIGINT) AS y1 FROM f WHERE len(xs) = 2"""


def contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF12, GRF13, SNK4
    """The lines of each origin stitched at their common ends: rings and open lines with points, and signed area; tested by hand."""
    import pandas as pd

    def stitch(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list[int]] = {}
        pieces = [((a, b), (c, d)) for a, b, c, d in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False) if (a, b) != (c, d)]
        for i, piece in enumerate(pieces):
            for e in piece:
                ends.setdefault(e, []).append(i)
        used, out = set(), []
        for start in sorted(range(len(pieces)), key=lambda i: (min(len(ends[e]) for e in pieces[i]), i)):
            if start in used:
                continue
            used.add(start)
            line = sorted(pieces[start], key=lambda e: (len(ends[e]), e))
            while True:
                onward = next((i for i in ends[line[-1]] if i not in used), None)
                if onward is None:
                    break
                used.add(onward)
                a, b = pieces[onward]
                line.append(b if a == line[-1] else a)
            closed = line[0] == line[-1] and len(line) > 3
            area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(line, [*line[1:], line[0]], strict=True)) / 2 if closed else 0.0
            shape = [{"x": x / 1e6, "y": y / 1e6} for x, y in line]
            out.append((key[0], len(out), closed, area / 1e12, shape))
        return pd.DataFrame(out, columns=["src", "ring", "closed", "area", "pts"])

    return contour_lines(spark, sf_dir).groupBy("src").applyInPandas(stitch, "src long, ring long, closed boolean, area double, pts array<struct<x:double,y:double>>")


PROGRAMS = {
    "route_path": (route_path, ROUTE_SQL),
    "route_json": (route_json, ROUTE_JSON_SQL),
    "isochrone_cells": (isochrone_cells, CELLS_SQL),
    "expansion_geojson": (expansion_geojson, EXPANSION_SQL),
    "bike_share": (bike_share, BIKE_SQL),
    "transit_arrivals": (transit_arrivals, TRANSIT_SQL),
    "connectivity": (connectivity, LINKED_SQL),
    "edge_chains": (chains, CHAINS_SQL),
    "contour_lines": (contour_lines, contour_sql()),
    "contour_rings": (contour_rings, None),
}
QUERIES = {name: partial(f) for name, (f, _) in PROGRAMS.items()}
ORACLES = {name: sql for name, (_, sql) in PROGRAMS.items() if sql}
