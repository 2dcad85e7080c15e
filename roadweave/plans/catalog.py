"""The registered queries of the network engine and their DuckDB twins.

``SQL`` holds statements in the dialect that both engines share; ``PROGRAMS`` holds DataFrame programs, whose twin is
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.geo import METRES_PER_DEGREE, bearing, fixed, haversine, planar, tile_id, turn_degree, turn_type
from roadweave.operators.search import converge, cut, widening
from roadweave.plans import derive
from roadweave.plans.derive import DEPARTURES, EDGES, HOPS, NODES, TRACES, idiv

PAIRS = EDGES + ", pairs AS (SELECT a.eid AS e1, b.eid AS e2, a.road_class AS c1, b.road_class AS c2, a.u AS u, a.v AS x, b.v AS v, a.heading AS h1, b.heading AS h2, b.density AS density, a.cost_ms AS w1, b.cost_ms AS w2 FROM edges a JOIN edges b ON a.v = b.u)"
FACTOR = "(850 + 25 * density + CASE road_class WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 0 END + CASE surface WHEN 3 THEN 50 WHEN 4 THEN 100 WHEN 5 THEN 250 WHEN 6 THEN 500 ELSE 0 END + 500 * toll)"
SQL: dict[str, str] = {
    # FLT1, FLT2, FLT8, FLT11
    "edge_access_filter": f"WITH {EDGES} SELECT eid, u, v, access FROM edges WHERE (access & 1) <> 0 AND surface < 6 AND rule <> 3",
    "edge_exclusions": f"WITH {EDGES} SELECT eid, road_class FROM edges WHERE toll = 0 AND tunnel = 0 AND bridge = 0 AND road_class BETWEEN 1 AND 6",
    # FLT3
    "edge_access_reverse": f"WITH {EDGES} SELECT a.eid, b.eid AS opp FROM edges a JOIN edges b ON a.u = b.v AND a.v = b.u WHERE (b.access & 1) <> 0",
    # FLT4
    "vehicle_dimension_filter": f"WITH {EDGES}, limits AS (SELECT eid, 250 + rule * 40 AS height_cm, 300 + rule * 100 AS weight FROM edges WHERE rule < 5) SELECT e.eid FROM edges e WHERE NOT EXISTS (SELECT 1 FROM limits l WHERE l.eid = e.eid AND (l.height_cm < 411 OR l.weight < 500))",
    # FLT9, SET3, JON13
    "avoid_edges_antijoin": f"WITH {EDGES} SELECT eid, u, v FROM edges WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = edges.eid AND o.o_orderkey % 3 = 0)",
    # FLT10
    "avoid_polygon_edges": f"WITH {EDGES}, zones AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 10 AS c0, {idiv('n_nationkey', 5)} * 8 AS r0 FROM nation WHERE n_nationkey % 3 = 0) SELECT DISTINCT e.eid FROM edges e JOIN zones z ON e.u % 50 BETWEEN z.c0 AND z.c0 + 4 AND {idiv('e.u', 50)} BETWEEN z.r0 AND z.r0 + 3",
    # FLT13
    "heading_filter": f"WITH {EDGES} SELECT eid, least(abs(heading - size * 7), 360 - abs(heading - size * 7)) AS off FROM edges WHERE least(abs(heading - size * 7), 360 - abs(heading - size * 7)) <= 60",
    # FLT5
    "turn_restriction_antijoin": f"WITH {PAIRS} SELECT p.e1, p.e2 FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 11 = 0 AND o.o_orderkey = p.e1 AND o.o_custkey % 4 = p.e2 % 4) AND p.u <> p.v",
    # FLT7
    "probabilistic_restriction": f"WITH {EDGES} SELECT eid, (eid * 31) % 101 AS probability FROM edges WHERE (eid * 31) % 101 < 60",
    # FLT16, SPD1, AGG13, JON6
    "speed_resolution": f"WITH {EDGES}, live AS (SELECT event_id % 8000 AS eid, CAST(floor(avg(CAST(floor(value) AS BIGINT) % 120)) AS BIGINT) AS overall, count(*) AS n FROM events GROUP BY event_id % 8000) SELECT e.eid, CASE WHEN l.overall IS NOT NULL AND l.overall > 0 THEN l.overall WHEN e.eid % 3 = 0 THEN e.speed - 5 WHEN e.eid % 3 = 1 THEN e.speed + 5 ELSE e.speed END AS kmh, CASE WHEN l.overall > 0 THEN 8 WHEN e.eid % 3 = 0 THEN 4 WHEN e.eid % 3 = 1 THEN 2 ELSE 0 END AS flow, CASE WHEN l.overall = 0 THEN 1 ELSE 0 END AS closed FROM edges e LEFT JOIN live l ON l.eid = e.eid",
    # CST1, CST16, GEO29, GEO33, SPD5
    "edge_cost_auto": f"WITH {EDGES} SELECT eid, {idiv('360000', 'least(speed, 140)')} AS ms, {idiv(idiv('360000', 'least(speed, 140)') + ' * ' + FACTOR, 1000)} AS cost, length_m AS shortest FROM edges",
    # CST6
    "edge_cost_taxi": f"WITH {EDGES} SELECT eid, {idiv('cost_ms * ' + FACTOR + ' * CASE WHEN rule = 4 THEN 85 ELSE 100 END', 100000)} AS cost FROM edges WHERE (access & 1) <> 0",
    # CST7
    "edge_cost_truck": f"WITH {EDGES} SELECT eid, {idiv('360000 * (CASE WHEN road_class > 4 THEN 2 ELSE 1 END)', 'least(speed, 90)')} AS cost FROM edges WHERE (access & 8) <> 0",
    # CST8, CST9
    "edge_cost_scooter": f"WITH {EDGES} SELECT eid, {idiv('36000000', 'least(speed, 45) * (CASE surface WHEN 2 THEN 90 WHEN 3 THEN 60 WHEN 4 THEN 10 ELSE 100 END)')} AS cost FROM edges WHERE surface < 5",
    # CST10; fixed values: percent of speed by grade
    "edge_cost_bicycle": f"WITH {EDGES} SELECT eid, {idiv('36000000', '18 * (CASE grade WHEN 0 THEN 220 WHEN 1 THEN 200 WHEN 2 THEN 190 WHEN 3 THEN 170 WHEN 4 THEN 140 WHEN 5 THEN 120 WHEN 6 THEN 100 WHEN 7 THEN 95 WHEN 8 THEN 85 WHEN 9 THEN 75 WHEN 10 THEN 65 WHEN 11 THEN 55 WHEN 12 THEN 50 WHEN 13 THEN 45 WHEN 14 THEN 40 ELSE 30 END)')} AS cost FROM edges WHERE (access & 4) <> 0",
    # CST11; fixed values: walking speed and seconds by stop impact
    "edge_cost_pedestrian": f"WITH {EDGES} SELECT eid, {idiv('3600000 * (100 + 10 * surface)', '51 * 100')} AS cost FROM edges WHERE (access & 2) <> 0",
    # CST12
    "transit_leg_cost": f"WITH {DEPARTURES} SELECT line_id, trip, seq, dep, (CASE WHEN line_id % 2 = 0 THEN 15 ELSE 300 END) + {idiv('dep', 60)} AS cost FROM departures WHERE days >= 64",
    # CST14, CST15
    "partial_edge_cost": f"WITH {EDGES} SELECT eid, {idiv('cost_ms * (100 - (eid % 100))', 100)} AS tail_cost, {idiv('cost_ms * (eid % 100)', 100)} AS head_cost FROM edges",
    # CST2, CST3, GEO11, GEO12, WIN2; fixed values: turn weights
    "turn_cost_pairs": f"WITH {PAIRS}, t AS (SELECT *, {turn_degree('h1', 'h2')} AS degree FROM pairs) SELECT e1, e2, degree, {turn_type('degree')} AS turn, CASE WHEN degree = 0 THEN 500 WHEN degree = 90 THEN 1000 WHEN degree = 180 THEN 9500 ELSE 2500 END * (1 + density) AS turn_ms FROM t",
    # CST5
    "uturn_penalty": f"WITH {PAIRS} SELECT e1, e2, CASE WHEN c1 = c2 THEN 600000 ELSE 10000 END AS penalty_ms FROM pairs WHERE u = v",
    # CST4
    "transition_cost": f"WITH {PAIRS} SELECT e1, e2, CASE WHEN x % 5 = 1 THEN 30000 WHEN x % 5 = 2 THEN 15000 ELSE 0 END + CASE WHEN c1 <> c2 THEN 5000 ELSE 0 END AS cost_ms FROM pairs",
    # CST19
    "stop_impact": f"WITH {PAIRS}, b AS (SELECT x, min(c1) AS best FROM pairs GROUP BY x) SELECT p.e1, p.e2, least(7, greatest(0, p.c1 - b.best + CASE WHEN p.h1 = p.h2 THEN 0 ELSE 1 END)) AS impact FROM pairs p JOIN b ON b.x = p.x",
    # CST18, CST21
    "straight_line_estimate": f"WITH {EDGES} SELECT eid, {fixed(haversine('lon_u', 'lat_u', 'lon_v', 'lat_v') + ' * 3.6E0 / 140')} AS ms FROM edges",
    # JON1, JON3
    "edge_end_nodes": f"WITH {EDGES} SELECT e.eid, n.density AS end_density, n.node_type FROM edges e JOIN nodes n ON n.gid = e.v",
    # JON2
    "opposing_edge_join": f"WITH {EDGES} SELECT a.eid, b.eid AS opp_eid, a.cost_ms - b.cost_ms AS difference FROM edges a JOIN edges b ON a.u = b.v AND a.v = b.u",
    # JON4
    "outbound_edges": f"WITH {EDGES} SELECT n.gid, count(*) AS degree, min(e.eid) AS first_eid, CAST(sum(e.cost_ms) AS BIGINT) AS total FROM nodes n JOIN edges e ON e.u = n.gid GROUP BY n.gid",
    # JON5, ETL12
    "level_assignment": f"WITH {EDGES}, l AS (SELECT u AS gid, CASE WHEN road_class <= 2 THEN 0 WHEN road_class <= 5 THEN 1 ELSE 2 END AS level FROM edges) SELECT gid, level, count(*) AS n FROM l GROUP BY gid, level",
    # JON7, GEO27, GEO28
    "edge_bins": f"WITH {EDGES} SELECT eid, {tile_id('lon_u', 'lat_u', 0.25)} AS tile, {tile_id('lon_u', 'lat_u', 0.05)} AS bin FROM edges",
    # JON10, GEO7, GEO8, ETL10
    "admin_point_in_polygon": f"WITH {NODES}, z AS (SELECT n_nationkey, (n_nationkey % 5) * 10 AS c0, {idiv('n_nationkey', 5)} * 8 AS r0, n_regionkey FROM nation) SELECT n.gid, z.n_nationkey, z.n_regionkey FROM nodes n JOIN z ON {idiv('n.c', 10)} * 10 = z.c0 AND {idiv('n.r', 8)} * 8 = z.r0 WHERE (n.c - z.c0) + (n.r - z.r0) <= 12",
    # JON11, WIN11
    "departure_asof": f"WITH {DEPARTURES}, q AS (SELECT c_custkey AS q, c_custkey % 100 AS line_id, (c_custkey * 379) % 86400 AS t FROM customer), k AS (SELECT q.q, q.t, d.dep, d.trip, d.seq, row_number() OVER (PARTITION BY q.q ORDER BY d.dep, d.trip, d.seq, d.stop) AS rn FROM q JOIN departures d ON d.line_id = q.line_id AND d.dep >= q.t AND d.days >= 64) SELECT q, t, dep, trip, CAST(seq AS BIGINT) AS seq, dep - t AS wait FROM k WHERE rn = 1",
    # JON12
    "frequency_interval": f"WITH {DEPARTURES}, f AS (SELECT line_id, min(dep) AS start_t, max(dep) AS end_t, 600 + line_id * 7 AS headway FROM departures GROUP BY line_id), q AS (SELECT c_custkey AS q, c_custkey % 100 AS line_id, (c_custkey * 379) % 86400 AS t FROM customer) SELECT q.q, f.start_t + greatest(0, {idiv('q.t - f.start_t + f.headway - 1', 'f.headway')}) * f.headway AS dep FROM q JOIN f ON f.line_id = q.line_id AND q.t <= f.end_t",
    # JON16
    "stop_trip_route": f"WITH {DEPARTURES} SELECT s.s_nationkey AS agency, d.line_id, count(DISTINCT d.trip) AS trips, count(DISTINCT d.stop) AS stops FROM departures d JOIN supplier s ON s.s_suppkey = d.line_id GROUP BY s.s_nationkey, d.line_id",
    # AGG1
    "min_label_per_node": f"WITH {HOPS}, k AS (SELECT u, v, w, row_number() OVER (PARTITION BY v ORDER BY w, u) AS rn FROM hops) SELECT v, u AS pred, w FROM k WHERE rn = 1",
    # AGG3
    "node_density": f"WITH {EDGES}, cells AS (SELECT {idiv('u', 250)} AS cr, {idiv('u % 50', 5)} AS cc, CAST(sum(length_m) AS BIGINT) AS m FROM edges GROUP BY {idiv('u', 250)}, {idiv('u % 50', 5)}), spread AS (SELECT cr + dr AS cr, cc + dc AS cc, m FROM cells CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) d(dr, dc)), near AS (SELECT cr, cc, sum(m) AS m FROM spread GROUP BY cr, cc) SELECT a.cr, a.cc, CAST(least(15, floor(b.m * 0.7E0 / 10000 + 0.5E0)) AS BIGINT) AS density FROM cells a JOIN near b ON a.cr = b.cr AND a.cc = b.cc",
    # AGG6, WIN1, WIN4, CST20
    "recost_path": f"WITH {HOPS} SELECT l_orderkey, l_linenumber, CAST(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS elapsed FROM lines",
    # AGG8, AGG9, AGG10, AGG14, SNK19
    "tile_statistics_rollup": f"WITH {EDGES} SELECT {idiv('u', 500)} AS tile, road_class, count(*) AS n, CAST(sum(length_m) AS BIGINT) AS metres, CAST(sum(cost_ms) AS BIGINT) AS ms, CAST(sum(CASE WHEN rule = 0 THEN 1 ELSE 0 END) AS BIGINT) AS one_way FROM edges GROUP BY ROLLUP ({idiv('u', 500)}, road_class)",
    # AGG11
    "traffic_coverage": "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS high, count(DISTINCT user_id) AS users, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
    # AGG12, GRF15
    "tour_cost": f"WITH {HOPS}, t AS (SELECT l_orderkey, p, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM lines) SELECT l_orderkey, CAST(sum(abs({idiv('p', 50)} - {idiv('nxt', 50)}) + abs(p % 50 - nxt % 50)) AS BIGINT) AS cost FROM t WHERE nxt IS NOT NULL GROUP BY l_orderkey",
    # AGG15
    "route_summary": f"WITH {HOPS} SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS seconds, count(*) * 100 AS metres, min(p % 50) AS min_col, max(p % 50) AS max_col, max(CASE WHEN p % 17 = 0 THEN 1 ELSE 0 END) AS has_toll FROM lines GROUP BY l_orderkey",
    # AGG16, ETL18
    "data_quality": f"WITH {EDGES} SELECT CASE WHEN access = 2 THEN 'foot_only' WHEN surface = 6 THEN 'impassable' WHEN speed > 60 THEN 'fast' ELSE 'plain' END AS issue, count(*) AS n FROM edges GROUP BY CASE WHEN access = 2 THEN 'foot_only' WHEN surface = 6 THEN 'impassable' WHEN speed > 60 THEN 'fast' ELSE 'plain' END",
    # AGG17, WIN5, WIN10, NAR1, NAR2
    "maneuver_grouping": f"WITH {HOPS}, b AS (SELECT l_orderkey, l_linenumber, p, q, CASE WHEN lag(p % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = p % 4 THEN 0 ELSE 1 END AS brk FROM lines), g AS (SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM b) SELECT l_orderkey, CAST(m AS BIGINT) AS maneuver, min(l_linenumber) AS first_line, count(*) AS edges, CAST(sum(q) AS BIGINT) AS seconds FROM g GROUP BY l_orderkey, m",
    # WIN8, STM2
    "trace_islands": f"WITH {TRACES}, b AS (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY seq)) + abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY seq)) <= 20 THEN 0 ELSE 1 END AS brk FROM traces), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM b) SELECT user_id, CAST(seg AS BIGINT) AS segment, count(*) AS points, min(seq) AS first_seq, max(seq) AS last_seq FROM g GROUP BY user_id, seg",
    # WIN9
    "multi_cue_lookahead": f"WITH {HOPS} SELECT l_orderkey, l_linenumber, CASE WHEN lead(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) < 10 THEN 1 ELSE 0 END AS multi_cue FROM lines",
    # SRT1, SRT3, SRT6, SRT7
    "alternates_sorted": f"WITH {HOPS}, k AS (SELECT v, u, w, min(w) OVER (PARTITION BY v) AS best, row_number() OVER (PARTITION BY v ORDER BY w, u) AS rn FROM hops) SELECT v, u, w FROM k WHERE w <= 2 * best AND rn <= 3",
    # SET2, SET5, GRF5
    "alternates_sharing": f"WITH {HOPS}, o AS (SELECT l_orderkey, p FROM lines GROUP BY l_orderkey, p), s AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS shared FROM o a JOIN o b ON a.p = b.p AND a.l_orderkey < b.l_orderkey GROUP BY a.l_orderkey, b.l_orderkey) SELECT x, y, shared FROM s WHERE shared >= 2",
    # SET4, SNP3, FLT20
    "edges_in_bbox": f"WITH {EDGES} SELECT DISTINCT eid, u, v FROM edges WHERE lon_u BETWEEN 5.01E0 AND 5.02E0 AND lat_u BETWEEN 52.005E0 AND 52.02E0",
    # GEO1, GEO2, GEO10
    "edge_geometry": f"WITH {EDGES} SELECT eid, {fixed(haversine('lon_u', 'lat_u', 'lon_v', 'lat_v'))} AS millimetres, {fixed(bearing('lon_u', 'lat_u', 'lon_v', 'lat_v'))} AS millidegrees, {fixed(planar('lon_u', 'lat_u', 'lon_v', 'lat_v'))} AS squared FROM edges",
    # GEO26
    "mercator_pixels": f"WITH {NODES} SELECT gid, CAST(floor((lon + 180) / 360 * 65536 * 4096) AS BIGINT) AS px, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536 * 4096) AS BIGINT) AS py FROM nodes",
    # GEO13
    "relative_direction": f"WITH {PAIRS}, t AS (SELECT e1, e2, {turn_degree('h1', 'h2')} AS degree FROM pairs) SELECT e1, e2, CASE WHEN degree > 329 OR degree < 31 THEN 'straight' WHEN degree < 160 THEN 'right' WHEN degree <= 200 THEN 'reverse' ELSE 'left' END AS direction FROM t",
    # STR6, STR7, STR8, STR12, GRF25
    "names_and_ids": "SELECT p_partkey, concat_ws('/', CAST(p_partkey % 3 AS VARCHAR(9)), CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS VARCHAR(19)), CAST(p_partkey AS VARCHAR(19))) AS graph_id, CAST(length(p_name) AS BIGINT) AS chars, upper(p_brand) AS brand FROM part",
    # DAT2, DAT10, STM4
    "weekly_speed_profile": "SELECT user_id % 10 AS edge, CAST(floor(((dayofweek(ts) + 6) % 7 * 86400 + hour(ts) * 3600 + minute(ts) * 60) / 300) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events) e GROUP BY user_id % 10, CAST(floor(((dayofweek(ts) + 6) % 7 * 86400 + hour(ts) * 3600 + minute(ts) * 60) / 300) AS BIGINT)",
    # DAT1, DAT6
    "conditional_active": "SELECT o_orderkey, CASE WHEN hour(o_orderdate) < 19 AND month(o_orderdate) BETWEEN 3 AND 10 AND day(o_orderdate) <= 21 THEN 1 ELSE 0 END AS active FROM orders",
    # DAT9
    "service_days_mask": f"WITH {DEPARTURES} SELECT line_id, CAST(bit_or(days) AS BIGINT) AS any_day, CAST(bit_and(days) AS BIGINT) AS every_day FROM departures GROUP BY line_id",
    # ETL2
    "edge_split": f"WITH {HOPS}, cnt AS (SELECT p, count(DISTINCT l_orderkey) AS uses FROM lines GROUP BY p), f AS (SELECT l.l_orderkey, l.l_linenumber, l.p, CASE WHEN c.uses > 20 THEN 1 ELSE 0 END AS is_node FROM lines l JOIN cnt c ON c.p = l.p), g AS (SELECT *, sum(is_node) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece FROM f) SELECT l_orderkey, CAST(piece AS BIGINT) AS piece, min(l_linenumber) AS first_line, count(*) AS nodes FROM g GROUP BY l_orderkey, piece",
    # ETL5
    "restriction_bitmask": f"WITH {PAIRS} SELECT e1, CAST(sum(CASE WHEN (e1 + e2) % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS restricted, CAST(bit_or(CASE e2 % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) AS BIGINT) AS mask FROM pairs GROUP BY e1",
    # ETL3, ETL23
    "edge_info_dedupe": f"WITH {EDGES} SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS directions, min(eid) AS eid FROM edges GROUP BY least(u, v), greatest(u, v)",
    # ETL13, GRF27
    "shortcut_chain": f"WITH {HOPS}, d AS (SELECT u, count(*) AS outs, min(v) AS only_v, min(w) AS w FROM hops GROUP BY u) SELECT a.u, a.only_v AS via, b.only_v AS v, a.w + b.w AS w FROM d a JOIN d b ON b.u = a.only_v WHERE a.outs <= 12 AND b.outs <= 12",
    # ETL20, SNK17
    "ways_to_edges": f"WITH {EDGES} SELECT {idiv('u', 50)} AS way_id, count(*) AS edges, min(eid) AS first_eid, max(eid) AS last_eid FROM edges GROUP BY {idiv('u', 50)}",
    # SNK18
    "tile_manifest": f"WITH {EDGES} SELECT {tile_id('lon_u', 'lat_u', 0.25)} AS tile, count(*) AS edges, count(DISTINCT u) AS nodes FROM edges GROUP BY {tile_id('lon_u', 'lat_u', 0.25)}",
    # SPD3
    "default_speeds": f"WITH {EDGES} SELECT eid, CASE WHEN density > 8 THEN CASE road_class WHEN 0 THEN 89 WHEN 1 THEN 73 WHEN 2 THEN 57 WHEN 3 THEN 49 WHEN 4 THEN 40 WHEN 5 THEN 35 WHEN 6 THEN 30 ELSE 20 END ELSE speed END AS kmh FROM edges",
    # SNP6
    "transit_available": f"WITH {NODES}, {DEPARTURES}, tiles AS (SELECT DISTINCT {idiv('stop', 250)} AS tile FROM departures WHERE line_id % 10 = 0) SELECT gid, CASE WHEN {idiv('gid', 250)} IN (SELECT tile FROM tiles) THEN 1 ELSE 0 END AS available FROM nodes",
    # MM3
    "transition_cost_match": f"WITH {TRACES}, w AS (SELECT user_id, seq, x, y, lag(x) OVER (PARTITION BY user_id ORDER BY seq) AS x0, lag(y) OVER (PARTITION BY user_id ORDER BY seq) AS y0 FROM traces) SELECT user_id, seq, {fixed('abs(abs(x - x0) + abs(y - y0) - sqrt(pow(x - x0, 2) + pow(y - y0, 2))) / 3.0E0', 1000000)} AS cost FROM w WHERE x0 IS NOT NULL",
}

LATTICE = "SELECT u, v, cost_ms AS w FROM edges"

# The searches without a hop bound: from the lattice node at the corner of every nation's zone to every node.
DEPOTS = f"SELECT DISTINCT n.gid AS src, n.gid AS node FROM nation z JOIN nodes n ON n.gid = {idiv('z.n_nationkey', 5)} * 400 + (z.n_nationkey % 5) * 10"


def whole_labels(spark: SparkSession, sf_dir: str, reverse: bool = False, limit: int | None = None) -> DataFrame:
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} {LATTICE}")
    seeds = derive.run(spark, sf_dir, f"WITH {NODES} {DEPOTS}")
    return converge(seeds, edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w") if reverse else edges, limit=limit)


def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF1, GRF2, GRF16, EXT3
    return whole_labels(spark, sf_dir).select("src", "node", "cost", F.col("dist").alias("hops"))


def sssp_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF1 reverse, GRF21
    return whole_labels(spark, sf_dir, reverse=True).select("src", "node", "cost", F.col("dist").alias("hops"))


def matrix_time_distance(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF7, GRF8, GRF10, SNK2; null where a target can't be reached
    cells = derive.run(spark, sf_dir, f"WITH {NODES} SELECT s.src, n.gid AS dst FROM ({DEPOTS}) s CROSS JOIN nodes n")
    found = whole_labels(spark, sf_dir).select("src", F.col("node").alias("dst"), F.col("cost").alias("time_ms"), (F.col("dist") * 100).alias("distance_m"))
    return cells.join(found, ["src", "dst"], "left")


def matrix_nearest_n(spark: SparkSession, sf_dir: str) -> DataFrame:  # SRT5; the origin itself isn't a target
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy("time_ms", "dst"))
    return matrix_time_distance(spark, sf_dir).where("time_ms IS NOT NULL AND src <> dst").withColumn("rank", rank.cast("long")).where("rank <= 2").select("src", "dst", "time_ms", "rank")


def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG7, GRF17
    return whole_labels(spark, sf_dir).groupBy("src").agg(F.count("*").alias("reach"))


def bidirectional_meet(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF3, JON15
    """Both searches up to a limit hold every way that is no longer than twice the limit less an edge, as on it a node then is
    within the limit from both ends; the limit grows until that is so of all pairs."""
    origins = derive.run(spark, sf_dir, f"WITH {NODES} {DEPOTS}").count()
    longest = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT max(cost_ms) AS w FROM edges").first()["w"] or 0

    def search(limit: int | None) -> DataFrame:
        forward, back = whole_labels(spark, sf_dir, limit=limit), whole_labels(spark, sf_dir, reverse=True, limit=limit)
        both = forward.select("src", "node", "cost").join(back.select(F.col("src").alias("dst"), "node", F.col("cost").alias("rest")), "node").where("src <> dst")
        return cut(both.groupBy("src", "dst").agg(F.min(F.col("cost") + F.col("rest")).alias("cost")), "met")

    def whole(met: DataFrame, limit: int) -> bool:
        return met.where(F.col("cost") <= 2 * limit - longest).count() == origins * (origins - 1)

    return widening(search, whole)


def centroid_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF14, SET6
    """The nodes that every origin reaches, with what all together spend to meet there; ``best`` marks the cheapest."""
    labels = cut(whole_labels(spark, sf_dir), "labels")
    origins = labels.select("src").distinct().count()
    met = labels.groupBy("node").agg(F.count_distinct("src").alias("origins"), F.sum("cost").alias("total")).where(F.col("origins") == origins)
    least = met.agg(F.min("total").alias("least"))
    return met.crossJoin(F.broadcast(least)).select("node", "origins", "total", (F.col("total") == F.col("least")).cast("int").alias("best"))


def _until_stable(name: str, edges: str) -> str:
    """Labels that only improvements replace, for DuckDB; the recursion ends when a round improves none."""
    return f"""{name}(src, node, cost, dist) USING KEY (src, node) AS (SELECT src, node, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({DEPOTS}) s
  UNION SELECT x.src, x.node, x.p.c, x.p.d FROM (SELECT l.src, e.v AS node, min({{'c': l.cost + e.w, 'd': l.dist + 1}}) AS p FROM {name} l JOIN ({edges}) e ON e.u = l.node GROUP BY l.src, e.v) x
  LEFT JOIN recurring.{name} o ON o.src = x.src AND o.node = x.node WHERE o.cost IS NULL OR x.p.c < o.cost OR (x.p.c = o.cost AND x.p.d < o.dist))"""


_WHOLE = f"WITH RECURSIVE {EDGES}, {_until_stable('l', LATTICE)}"
_WHOLE_BACK = _until_stable("b", "SELECT v AS u, u AS v, cost_ms AS w FROM edges")
_CELLS = f"SELECT s.src, n.gid AS dst, l.cost AS time_ms, l.dist * 100 AS distance_m FROM ({DEPOTS}) s CROSS JOIN nodes n LEFT JOIN l ON l.src = s.src AND l.node = n.gid"
PROGRAMS = {
    "sssp": (sssp, f"{_WHOLE} SELECT src, node, cost, dist AS hops FROM l"),
    "sssp_reverse": (sssp_reverse, f"WITH RECURSIVE {EDGES}, {_WHOLE_BACK} SELECT src, node, cost, dist AS hops FROM b"),
    "matrix_time_distance": (matrix_time_distance, f"{_WHOLE} {_CELLS}"),
    "matrix_nearest_n": (matrix_nearest_n, f"{_WHOLE} SELECT src, dst, time_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time_ms, dst) AS rank FROM ({_CELLS}) m WHERE time_ms IS NOT NULL AND src <> dst) k WHERE rank <= 2"),
    "bfs_reach": (bfs_reach, f"{_WHOLE} SELECT src, count(*) AS reach FROM l GROUP BY src"),
    "bidirectional_meet": (bidirectional_meet, f"{_WHOLE}, {_WHOLE_BACK} SELECT f.src, b.src AS dst, min(f.cost + b.cost) AS cost FROM l f JOIN b ON f.node = b.node WHERE f.src <> b.src GROUP BY f.src, b.src"),
    "centroid_convergence": (centroid_convergence, f"{_WHOLE}, m AS (SELECT node, count(DISTINCT src) AS origins, CAST(sum(cost) AS BIGINT) AS total FROM l GROUP BY node) SELECT *, CASE WHEN rank() OVER (ORDER BY total) = 1 THEN 1 ELSE 0 END AS best FROM m WHERE origins = (SELECT count(DISTINCT src) FROM l)"),
}

# Traces to edges by the distance from the point to the segment; squared metres times 1000.
POINTS = "SELECT event_id, 5.0E0 + x * 0.001E0 + 0.0003E0 AS lon, 52.0E0 + y * 0.001E0 + 0.0002E0 AS lat FROM traces"
SEGMENTS = "SELECT eid, lon_u, lat_u, lon_v, lat_v FROM edges"
CELL, CUTOFF, SEARCH_RADIUS = 0.001, 35_000, 50


def to_segments(pairs: str) -> str:
    """(event_id, eid, d2) of pairs (event_id, lon, lat, eid and the segment's ends), planar at the point's latitude."""
    metres = f"{METRES_PER_DEGREE!r}E0"
    flat = f"SELECT event_id, eid, (lon_u - lon) * cos(radians(lat)) * {metres} AS ax, (lat_u - lat) * {metres} AS ay, (lon_v - lon_u) * cos(radians(lat)) * {metres} AS dx, (lat_v - lat_u) * {metres} AS dy FROM {pairs}"
    along = f"SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0E0 ELSE least(1.0E0, greatest(0.0E0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM ({flat}) flat"
    return f"SELECT event_id, eid, {fixed('pow(ax + t * dx, 2) + pow(ay + t * dy, 2)', 1000)} AS d2 FROM ({along}) along"


def beside(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(event_id, eid, d2) of each point and all edges in its cell of ``size`` degrees and the eight around it."""
    spark = points.sparkSession
    cell = lambda e: F.floor(F.expr(e) / size)
    spread = lambda a, b: F.explode(F.sequence(cell(f"least({a})"), cell(f"greatest({b})")))
    binned = edges.withColumn("cx", spread("lon_u, lon_v", "lon_u, lon_v")).withColumn("cy", spread("lat_u, lat_v", "lat_u, lat_v"))
    asked = points.withColumn("cx", F.explode(F.sequence(cell("lon") - 1, cell("lon") + 1))).withColumn("cy", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)))
    return spark.sql(to_segments("{pairs}"), pairs=asked.join(binned, ["cx", "cy"])).distinct()


def nearest_edge_ring(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:  # JON8, SNP1, SNP2
    """The k nearest edges of each point within CUTOFF metres; cells double until the k-th is nearer than what they cover."""
    from pyspark.sql import Window

    edges = cut(derive.run(spark, sf_dir, f"WITH {EDGES} {SEGMENTS}"), "edges")
    left = cut(derive.run(spark, sf_dir, f"WITH {TRACES} {POINTS}"), "points")
    rank, size, found = F.row_number().over(Window.partitionBy("event_id").orderBy("d2", "eid")), CELL, []
    while True:
        near = cut(beside(left, edges, size).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k), "near")
        covered = F.pow(size * METRES_PER_DEGREE * F.cos(F.radians("lat")), F.lit(2.0)) * 1000 - 1
        whole = left.where(F.sqrt((covered + 1) / 1000) > CUTOFF).select("event_id")
        kth = near.where(F.col("rank") == k).select("event_id", "d2").join(left.select("event_id", covered.alias("covered")), "event_id").where("d2 < covered")
        done = cut(kth.select("event_id").union(whole).distinct(), "done")
        found.append(near.join(done, "event_id", "left_semi"))
        left = cut(left.join(done, "event_id", "left_anti"), "points")
        if left.isEmpty():
            break
        size *= 2
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where(F.col("d2") <= CUTOFF**2 * 1000).select("event_id", "eid", "d2", "rank")


def trace_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:  # JON9, MM1, MM2
    """All edges within SEARCH_RADIUS metres of each point; a cell is wider than that up to 63 degrees of latitude."""
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} {SEGMENTS}")
    near = beside(derive.run(spark, sf_dir, f"WITH {TRACES} {POINTS}"), edges, CELL).where(F.col("d2") <= SEARCH_RADIUS**2 * 1000)
    return near.select("event_id", "eid", "d2", F.expr(_EMISSION).alias("emission"))


_EMISSION = fixed("d2 / 1000.0E0 / (2 * 4.07E0 * 4.07E0)", 1000)
_ALL_PAIRS = f"WITH {EDGES}, {TRACES}, near AS ({to_segments(f'({POINTS}) p CROSS JOIN ({SEGMENTS}) e')})"
PROGRAMS |= {
    "nearest_edge_ring": (nearest_edge_ring, f"{_ALL_PAIRS} SELECT event_id, eid, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, eid) AS rank FROM near WHERE d2 <= {CUTOFF**2 * 1000}) k WHERE rank <= 3"),
    "trace_candidates": (trace_candidates, f"{_ALL_PAIRS} SELECT event_id, eid, d2, {_EMISSION} AS emission FROM near WHERE d2 <= {SEARCH_RADIUS**2 * 1000}"),
}

QUERIES = {name: partial(derive.run, sql=sql) for name, sql in SQL.items()} | {name: f for name, (f, _) in PROGRAMS.items()}
# Spark counts the days of the week from 1, DuckDB from 0; both start on Sunday.
_WEEK = {"weekly_speed_profile": SQL["weekly_speed_profile"].replace("(dayofweek(ts) + 6) % 7", "dayofweek(ts)")}
ORACLES = dict(SQL) | _WEEK | {name: sql for name, (_, sql) in PROGRAMS.items()}
