"""Results in the formats that a service gives out: JSON texts, GeoJSON and delimited edges, made in the JVM by ``to_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import codecs
from roadweave.plans import catalog, derive, matching, routes
from roadweave.plans.derive import EDGES, NODES
from roadweave.plans.shapes import shapes


def row_of(cells: DataFrame) -> DataFrame:
    """cells (src, dst, time_ms, distance_m) -> (src, row): a matrix's row as JSON, null where a target can't be reached."""
    cell = F.struct("dst", F.struct(F.col("src").alias("from_index"), F.col("dst").alias("to_index"), F.floor(F.col("time_ms") / 1000).alias("time"), F.col("distance_m").alias("distance")).alias("c"))
    listed = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["c"])
    return cells.groupBy("src").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("row"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.run(spark, sf_dir, f"WITH {NODES} SELECT src AS dst FROM ({catalog.DEPOTS}) d")


def matrix_json(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK2, JON14
    return row_of(catalog.matrix_time_distance(spark, sf_dir).join(depots(spark, sf_dir), "dst"))


MATRIX_SQL = f"""{catalog._WHOLE} SELECT s.src, '[' || string_agg('{{"from_index":' || s.src || ',"to_index":' || t.src || ',"time":' || coalesce((l.cost // 1000)::VARCHAR, 'null') || ',"distance":' || coalesce((l.dist * 100)::VARCHAR, 'null') || '}}', ',' ORDER BY t.src) || ']' AS row
 FROM ({catalog.DEPOTS}) s CROSS JOIN ({catalog.DEPOTS}) t LEFT JOIN l ON l.src = s.src AND l.node = t.src GROUP BY s.src"""


def matrix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK3
    """A row of durations and distances for each origin, as two arrays in the order of the targets."""
    cells = catalog.matrix_time_distance(spark, sf_dir).join(depots(spark, sf_dir), "dst")
    listed = cells.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", (F.col("time_ms") / 1000).alias("t"), "distance_m"))).alias("q"))
    return listed.select("src", F.to_json(F.struct(F.transform("q", lambda c: F.floor(c["t"])).alias("durations"), F.transform("q", lambda c: c["distance_m"]).alias("distances")), {"ignoreNullFields": "false"}).alias("row"))


ARRAYS_SQL = f"""{catalog._WHOLE} SELECT s.src, '{{"durations":[' || string_agg(coalesce((l.cost // 1000)::VARCHAR, 'null'), ',' ORDER BY t.src) || '],"distances":[' || string_agg(coalesce((l.dist * 100)::VARCHAR, 'null'), ',' ORDER BY t.src) || ']}}' AS row
 FROM ({catalog.DEPOTS}) s CROSS JOIN ({catalog.DEPOTS}) t LEFT JOIN l ON l.src = s.src AND l.node = t.src GROUP BY s.src"""


def height_json(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK6
    """Range and height of each shape's points as pairs; heights without data are null."""
    rows = matching.height_profile(spark, sf_dir)
    pair = F.array(F.floor(F.col("range") / 10), F.when(F.col("height") > -300_000, F.floor(F.col("height") / 10)))
    listed = rows.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("i", pair.alias("p")))).alias("q"))
    return listed.select("shape", F.to_json(F.struct(F.transform("q", lambda c: c["p"]).alias("range_height"))).alias("body"))


HEIGHT_SQL = f"""WITH h AS ({matching.ORACLES['height_profile']}) SELECT shape, '{{"range_height":[' || string_agg('[' || CAST(floor(range / 10.0) AS BIGINT) || ',' || CASE WHEN height > -300000 THEN CAST(floor(height / 10.0) AS BIGINT)::VARCHAR ELSE 'null' END || ']', ',' ORDER BY i) || ']}}' AS body FROM h GROUP BY shape"""


def isochrone_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK4, GRF13
    """The rings and lines of equal time of each origin as GeoJSON features; tested against the rings."""
    rings = routes.contour_rings(spark, sf_dir)
    place = F.transform("pts", lambda p: F.array(F.round(5.0 + p["x"] * 0.001, 6), F.round(52.0 + p["y"] * 0.001, 6)))
    geometry = F.struct(F.lit("LineString").alias("type"), place.alias("coordinates"))
    properties = F.struct(F.lit(routes.LEVEL // 1000).alias("contour"), F.lit("time").alias("metric"), F.col("closed"), F.when(F.col("area") < 0, "inner").otherwise("outer").alias("side"))
    return rings.select("src", "ring", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def export_edges(spark: SparkSession, sf_dir: str, delimiter: str = "|") -> DataFrame:  # SNK16, SNK17
    """A line for each edge: its polyline, its class and the names of its way, with a delimiter."""
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid, u, road_class, lon_u, lat_u, lon_v, lat_v FROM edges")
    pts = F.array(F.struct(F.col("lon_u").alias("x"), F.col("lat_u").alias("y")), F.struct(F.col("lon_v").alias("x"), F.col("lat_v").alias("y")))
    names = derive.run(spark, sf_dir, "SELECT p_partkey AS u, p_name AS name FROM part")
    return edges.join(names, "u").select("eid", F.concat_ws(delimiter, codecs.encode_polyline(pts, 6), F.col("road_class").cast("string"), "name").alias("line"))


def _text_of(a: str) -> str:
    z = f"(CASE WHEN {a} < 0 THEN -2 * ({a}) - 1 ELSE 2 * ({a}) END)"
    chunk = lambda k: f"CASE WHEN {k} = 0 OR ({z} >> {5 * k}) > 0 THEN chr(CAST((({z} >> {5 * k}) & 31) + 63 + CASE WHEN ({z} >> {5 * k + 5}) > 0 THEN 32 ELSE 0 END AS INTEGER)) ELSE '' END"
    return " || ".join(chunk(k) for k in range(6))


_MICRO = "CAST(round({c} * 1e6) AS BIGINT)"
EXPORT_SQL = f"""WITH {EDGES}, m AS (SELECT eid, u, road_class, {', '.join(_MICRO.format(c=c) + ' AS ' + c for c in ('lon_u', 'lat_u', 'lon_v', 'lat_v'))} FROM edges)
 SELECT eid, ({_text_of('lat_u')} || {_text_of('lon_u')} || {_text_of('(lat_v - lat_u)')} || {_text_of('(lon_v - lon_u)')}) || '|' || road_class || '|' || p_name AS line FROM m JOIN part ON p_partkey = u"""


def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK15
    """What the network holds, as one JSON text."""
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT u) AS nodes, max(toll) AS toll, CAST(sum(length_m) AS BIGINT) AS metres FROM edges")
    return edges.select(F.to_json(F.struct("edges", "nodes", (F.col("toll") == 1).alias("has_toll"), "metres")).alias("status"))


STATUS_SQL = f"""WITH {EDGES} SELECT '{{"edges":' || count(*) || ',"nodes":' || count(DISTINCT u) || ',"has_toll":' || CASE WHEN max(toll) = 1 THEN 'true' ELSE 'false' END || ',"metres":' || CAST(sum(length_m) AS BIGINT) || '}}' AS status FROM edges"""


def trace_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK12, MM6, MM8, FLT17
    """Each matched point as JSON with its edge's attributes."""
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid, road_class, speed, surface FROM edges")
    found = matching.viterbi_match(spark, sf_dir).join(edges, "eid")
    point = F.struct(F.when(F.col("fresh"), "start").otherwise("matched").alias("type"), F.struct("eid", "road_class", "speed", "surface").alias("edge"))
    return found.select("trace", "i", F.to_json(point).alias("point"))


def shape_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK10
    """A shape as a GPX track."""
    point = lambda p: F.format_string('<trkpt lat="%.6f" lon="%.6f"/>', p["y"], p["x"])
    return shapes(spark, sf_dir).select("shape", F.concat(F.lit('<gpx version="1.1"><trk><trkseg>'), F.array_join(F.transform("pts", point), ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def _gpx_sql() -> str:
    from roadweave.plans.shapes import Q

    return f"""{Q} SELECT shape, '<gpx version="1.1"><trk><trkseg>' || string_agg(printf('<trkpt lat="%.6f" lon="%.6f"/>', y, x), '' ORDER BY i) || '</trkseg></trk></gpx>' AS gpx FROM q GROUP BY shape"""


QUERIES = {f.__name__: f for f in (matrix_json, matrix_arrays, height_json, isochrone_geojson, export_edges, status_json, trace_attributes, shape_gpx)}
ORACLES = {"matrix_json": MATRIX_SQL, "matrix_arrays": ARRAYS_SQL, "height_json": HEIGHT_SQL, "export_edges": EXPORT_SQL, "status_json": STATUS_SQL, "shape_gpx": _gpx_sql()}
