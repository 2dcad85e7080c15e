"""Filters of requests, second passes, orders and mappings of ids, thinned traces, elevation offsets and turn instructions.

Spark programs are joins, windows and folds over arrays of bounded chunks; the DuckDB twins are recursions, subqueries and
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions.geo import turn_degree, turn_type
from roadweave.operators.search import converge, cut
from roadweave.plans import derive
from roadweave.plans.catalog import DEPOTS
from roadweave.plans.derive import DEPARTURES, EDGES, NODES, TRACES, idiv
from roadweave.plans.routes import _keyed

#: Sides of the street (0 none, 1 left, 2 right) and wishes (0 either, 1 same, 2 opposite) of the places beside edges.
SIDES = "SELECT eid, u, v, eid % 3 AS side, (u * 7 + dir) % 3 AS wish FROM edges"
CUTOFF = 5


def side_of_street(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT12, JON2
    """Candidate edges on the side that the place asks for; minor roads and places without a side or a wish pass."""
    places = derive.run(spark, sf_dir, f"WITH {EDGES} {SIDES}")
    back = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT u AS v, v AS u, road_class, u % 2 = 0 AS on_right FROM edges")
    same = F.col("on_right") == (F.col("side") == 2)
    free = (F.col("side") == 0) | (F.col("wish") == 0) | (F.col("road_class") > CUTOFF)
    found = places.join(back, ["u", "v"], "left")
    return found.where(F.col("road_class").isNull() | free | (same == (F.col("wish") == 1))).select("eid", "side", "wish")


SIDE_SQL = f"""WITH {EDGES}, s AS ({SIDES}), wrong AS (SELECT s.eid FROM s JOIN edges o ON o.u = s.v AND o.v = s.u WHERE o.road_class <= {CUTOFF} AND
 (s.side, s.wish, o.u % 2) IN ((2, 1, 1), (1, 1, 0), (2, 2, 0), (1, 2, 1))) SELECT eid, side, wish FROM s WHERE eid NOT IN (SELECT eid FROM wrong)"""

#: Access by node type (gate, bollard, toll booth, border, crossing): 1 car, 2 foot, 4 bicycle.
NODE_ACCESS = (1, 6, 7, 3, 2)


def node_access(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT15
    """Nodes that a mode may pass, and by how many edges they're left."""
    nodes = derive.run(spark, sf_dir, f"WITH {NODES} SELECT gid, node_type FROM nodes")
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT u AS gid FROM edges").groupBy("gid").agg(F.count("*").alias("edges"))
    mask = F.element_at(F.array(*map(F.lit, NODE_ACCESS)), F.col("node_type").cast("int") + 1)
    modes = nodes.withColumn("mode", F.explode(F.array(*map(F.lit, (1, 2, 4))))).where(mask.bitwiseAND(F.col("mode")) != 0)
    return modes.join(edges, "gid", "left").select("gid", "mode", F.coalesce("edges", F.lit(0)).alias("edges"))


NODE_SQL = f"""WITH {EDGES}, allowed(node_type, mode) AS (VALUES {', '.join(f'({t}, {m})' for t, a in enumerate(NODE_ACCESS) for m in (1, 2, 4) if a & m)})
 SELECT gid, mode, (SELECT count(*) FROM edges e WHERE e.u = n.gid) AS edges FROM nodes n JOIN allowed USING (node_type)"""

CHUNK, NEAR = 16, 12
TRACE = f"SELECT event_id, user_id * 1000000 + {idiv('seq - 1', CHUNK)} AS trace, CAST((seq - 1) % {CHUNK} AS BIGINT) AS i, x, y FROM traces"


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, i, x, y, of): ``of`` is the kept point that point i belongs to; a kept one is its own.

    The first and the last point of a chunk are kept, and each that is further than ``NEAR`` from the last one kept.
    """
    rows = derive.run(spark, sf_dir, f"WITH {TRACES} {TRACE}")
    points = rows.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    start = F.struct(F.get("p", F.lit(0)).alias("last"), F.array(F.lit(0).cast("long")).alias("of"))

    def step(state, q):
        far = F.pow(q["x"] - state["last"]["x"], 2) + F.pow(q["y"] - state["last"]["y"], 2) > NEAR * NEAR
        keep = far | (q["i"] == F.size("p") - 1)
        return F.struct(F.when(keep, q).otherwise(state["last"]).alias("last"), F.concat(state["of"], F.array(F.when(keep, q["i"]).otherwise(state["last"]["i"]))).alias("of"))

    folded = F.aggregate(F.slice("p", 2, CHUNK), start, step, lambda s: s["of"])
    return points.withColumn("of", folded).select("trace", F.inline(F.arrays_zip("p", "of"))).select("trace", "p.*", "of")


def trace_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN7
    return thinned(spark, sf_dir).select("trace", "i", "of", (F.col("i") == F.col("of")).cast("long").alias("kept"))


def trace_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN6
    """Each point that wasn't kept, projected onto the straight line between the kept ones around it: thousandths along it."""
    order = Window.partitionBy("trace").orderBy("i")
    kept = F.when(F.col("i") == F.col("of"), F.struct("x", "y"))
    around = thinned(spark, sf_dir).withColumn("a", F.last(kept, True).over(order)).withColumn("b", F.first(kept, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    along = (F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy
    share = F.coalesce(F.try_divide(1000 * along, dx * dx + dy * dy), F.lit(0))
    return around.where("i <> of").select("trace", "i", "of", F.floor(F.greatest(F.lit(0), F.least(F.lit(1000), share))).cast("long").alias("along"))


_THIN = f"""WITH RECURSIVE {TRACES}, t AS MATERIALIZED ({TRACE}), n AS (SELECT trace, max(i) AS z FROM t GROUP BY trace), f(trace, i, x, y, own, kx, ky) AS (SELECT trace, i, x, y, i, x, y FROM t WHERE i = 0
 UNION ALL SELECT t.trace, t.i, t.x, t.y, CASE WHEN k THEN t.i ELSE f.own END, CASE WHEN k THEN t.x ELSE f.kx END, CASE WHEN k THEN t.y ELSE f.ky END FROM f JOIN t ON t.trace = f.trace AND t.i = f.i + 1 JOIN n ON n.trace = t.trace,
 LATERAL (SELECT t.i = n.z OR (t.x - f.kx) * (t.x - f.kx) + (t.y - f.ky) * (t.y - f.ky) > {NEAR * NEAR} AS k) q)"""
THIN_SQL = f"{_THIN} SELECT trace, i, own AS of, CAST(i = own AS BIGINT) AS kept FROM f"
BETWEEN_SQL = f"""{_THIN}, k AS (SELECT a.trace, a.i AS a, b.i AS b, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM f a JOIN f b ON b.trace = a.trace AND b.i > a.i WHERE a.i = a.own AND b.i = b.own
 AND NOT EXISTS (SELECT 1 FROM f m WHERE m.trace = a.trace AND m.i = m.own AND m.i > a.i AND m.i < b.i)), s AS (SELECT f.trace, f.i, f.own, (f.x - ax) * dx + (f.y - ay) * dy AS d, dx * dx + dy * dy AS l FROM f JOIN k ON k.trace = f.trace AND f.i > k.a AND f.i < k.b)
 SELECT trace, i, own AS of, CAST(CASE WHEN l = 0 OR d < 0 THEN 0 WHEN d > l THEN 1000 ELSE floor(1000 * d / l) END AS BIGINT) AS along FROM s"""


def trace_ends(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNP5
    """The first and the last place of a trace, as the locations that it is searched with."""
    rows = derive.run(spark, sf_dir, f"WITH {TRACES} SELECT user_id, seq, x, y FROM traces")
    place = F.struct("x", "y")
    found = rows.groupBy("user_id").agg(F.min_by(place, "seq").alias("a"), F.max_by(place, "seq").alias("b"), F.count("*").alias("points"))
    return found.select("user_id", "points", *(F.col(f"{p}.{c}").alias(f"{c}_{n}") for p, n in (("a", "first"), ("b", "last")) for c in "xy"))


ENDS_SQL = f"""WITH {TRACES}, z AS (SELECT user_id, max(seq) AS z FROM traces GROUP BY user_id) SELECT z.user_id, z.z AS points, a.x AS x_first, a.y AS y_first, b.x AS x_last, b.y AS y_last
 FROM z JOIN traces a ON a.user_id = z.user_id AND a.seq = 1 JOIN traces b ON b.user_id = z.user_id AND b.seq = z.z"""


def admin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN10
    """Stretches of a trace within one administrative area, areas being blocks of 10 x 10 nodes."""
    rows = derive.run(spark, sf_dir, f"WITH {TRACES} SELECT user_id, seq, {idiv('x', 10)} * 10 + {idiv('y', 10)} AS admin FROM traces")
    order = Window.partitionBy("user_id").orderBy("seq")
    fresh = F.coalesce(F.lag("admin").over(order) != F.col("admin"), F.lit(True)).cast("long")
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("user_id", "run", "admin").agg(F.min("seq").alias("begin"), F.max("seq").alias("end"))


ADMIN_SQL = f"""WITH {TRACES}, t AS (SELECT user_id, seq, {idiv('x', 10)} * 10 + {idiv('y', 10)} AS admin FROM traces),
 g AS (SELECT *, seq - row_number() OVER (PARTITION BY user_id, admin ORDER BY seq) AS k FROM t), r AS (SELECT user_id, admin, min(seq) AS lo, max(seq) AS hi FROM g GROUP BY user_id, admin, k)
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lo) AS run, admin, lo AS begin, hi AS end FROM r"""

#: The first pass may use neither destination-only streets nor tolls, so some legs have no way in it.
STRICT = "SELECT u, v, cost_ms AS w FROM edges WHERE rule > 3 AND toll = 0"
LOOSE = "SELECT u, v, cost_ms AS w FROM edges"
LEGS = f"SELECT src, lead(src) OVER (ORDER BY src) AS node FROM ({DEPOTS}) d"


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF22
    """Cost of each leg between depots: of the strict pass where that finds a way, else of one over all streets, for the legs left."""
    legs = cut(derive.run(spark, sf_dir, f"WITH {NODES} SELECT * FROM ({LEGS}) l WHERE node IS NOT NULL"), "legs")
    at = lambda df: df.select("src", F.col("src").alias("node"))
    first = cut(converge(at(legs), derive.run(spark, sf_dir, f"WITH {EDGES} {STRICT}")).join(legs, ["src", "node"], "left_semi"), "first")
    left = cut(legs.join(first, ["src", "node"], "left_anti"), "left")
    again = converge(at(left), derive.run(spark, sf_dir, f"WITH {EDGES} {LOOSE}")).join(left, ["src", "node"], "left_semi")
    return first.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2))).select("src", "node", "cost", "pass")


PASS_SQL = f"""WITH RECURSIVE {EDGES}, legs AS MATERIALIZED (SELECT * FROM ({LEGS}) x WHERE node IS NOT NULL), strict AS MATERIALIZED ({STRICT}), loose AS MATERIALIZED ({LOOSE}),
 {_keyed('l', 'SELECT src, src AS node FROM legs', 'SELECT * FROM strict')}, {_keyed('m', 'SELECT src, src AS node FROM legs', 'SELECT * FROM loose')}
 SELECT legs.src, legs.node, coalesce(l.cost, m.cost) AS cost, CASE WHEN l.cost IS NULL THEN 2 ELSE 1 END AS pass FROM legs LEFT JOIN l ON l.src = legs.src AND l.node = legs.node JOIN m ON m.src = legs.src AND m.node = legs.node"""

TILE = f"{idiv('r', 8)} * 7 + {idiv('c', 8)}"


def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:  # SRT1, JON17
    """Each node's place in the order of (tile, type, id), without one task that holds all: ranges are sorted by themselves and
    their sizes, a row for each range, give where each begins. The place within the tile is the node's new index there."""
    rows = derive.run(spark, sf_dir, f"WITH {NODES} SELECT gid, {TILE} AS tile, node_type FROM nodes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, "tile", "node_type", "gid").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    begins = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("tile", "node_type", "gid"))
    placed = dealt.withColumn("k", place).join(F.broadcast(begins), "part").withColumn("place", F.col("begin") + F.col("k") - 1)
    first = placed.groupBy("tile").agg(F.min("place").alias("low"))
    return placed.join(first, "tile").select("gid", "tile", "place", (F.col("place") - F.col("low")).alias("idx"))


ORDER_SQL = f"WITH {NODES}, t AS (SELECT gid, {TILE} AS tile, node_type FROM nodes) SELECT gid, tile, row_number() OVER (ORDER BY tile, node_type, gid) - 1 AS place, row_number() OVER (PARTITION BY tile ORDER BY node_type, gid) - 1 AS idx FROM t"

#: A country's own access by road class, in place of the edge's.
COUNTRY = ((3, 0, 1), (3, 5, 7), (7, 0, 1), (7, 6, 6), (12, 1, 9), (18, 7, 2))


def country_access(spark: SparkSession, sf_dir: str) -> DataFrame:  # ETL21
    """Edges with the access that the country of their first node gives their road class; access tags of the way itself stand."""
    edges = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT eid, {idiv('u', 40)} % 25 AS country, road_class, access, surface = 3 AS tagged FROM edges")
    rules = spark.createDataFrame(COUNTRY, "country long, road_class long, given int")
    found = edges.join(F.broadcast(rules), ["country", "road_class"], "left")
    return found.select("eid", "country", F.when(F.col("given").isNull() | F.col("tagged"), F.col("access")).otherwise(F.col("given")).cast("int").alias("access"))


COUNTRY_SQL = f"""WITH {EDGES}, e AS (SELECT *, {idiv('u', 40)} % 25 AS country FROM edges) SELECT eid, country, CAST(CASE WHEN surface = 3 THEN access
 {' '.join(f'WHEN country = {c} AND road_class = {k} THEN {a}' for c, k, a in COUNTRY)} ELSE access END AS INTEGER) AS access FROM e"""

NO_DATA = -32768
HEIGHTS = f"SELECT l_orderkey AS shape, l_linenumber AS k, CASE WHEN p % 13 = 0 THEN {NO_DATA} ELSE p * 37 % 400 END AS quarters"
LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def elevation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:  # ELV3
    """Heights along an edge as differences of one byte, in quarter metres; what a byte can't hold is made up for by the next ones.

    Ends aren't encoded; a place without data gives 0; an edge with an end without data, or with no place between, gives none.
    """
    rows = derive.run(spark, sf_dir, f"WITH {LINES} {HEIGHTS} FROM lines")
    h = rows.groupBy("shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quarters"))), lambda q: q["quarters"]).alias("h"))

    def step(state, v):
        delta = F.greatest(F.lit(-128), F.least(F.lit(127), v - state["prior"]))
        none = v == NO_DATA
        return F.struct(F.when(none, state["prior"]).otherwise(state["prior"] + delta).alias("prior"), F.concat(state["out"], F.array(F.when(none, F.lit(0)).otherwise(delta))).alias("out"))

    start = F.struct(F.get("h", F.lit(0)).alias("prior"), F.array().cast("array<bigint>").alias("out"))
    good = (F.get("h", F.lit(0)) != NO_DATA) & (F.element_at("h", -1) != NO_DATA) & (F.size("h") > 2)
    inner = F.slice(F.col("h"), F.lit(2), F.greatest(F.size("h") - 2, F.lit(0)))
    coded = h.where(good).select("shape", F.aggregate(inner, start, step, lambda s: s["out"]).alias("out"))
    return coded.select("shape", F.array_join(F.transform("out", lambda x: x.cast("string")), ",").alias("offsets"))


OFFSETS_SQL = f"""WITH RECURSIVE {LINES}, h AS (SELECT shape, quarters, row_number() OVER (PARTITION BY shape ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY shape) AS n FROM ({HEIGHTS} FROM lines) x),
 ends AS (SELECT shape FROM h WHERE n > 2 AND (i = 0 OR i = n - 1) AND quarters <> {NO_DATA} GROUP BY shape HAVING count(*) = 2), f(shape, i, prior, d) AS (SELECT h.shape, h.i, h.quarters, CAST(NULL AS BIGINT) FROM h JOIN ends USING (shape) WHERE i = 0
 UNION ALL SELECT h.shape, h.i, CASE WHEN quarters = {NO_DATA} THEN prior ELSE prior + c END, CASE WHEN quarters = {NO_DATA} THEN 0 ELSE c END FROM f JOIN h ON h.shape = f.shape AND h.i = f.i + 1 AND h.i < h.n - 1,
 LATERAL (SELECT CASE WHEN quarters - prior > 127 THEN 127 WHEN quarters - prior < -128 THEN -128 ELSE quarters - prior END AS c) q)
 SELECT shape, string_agg(CAST(d AS VARCHAR), ',' ORDER BY i) AS offsets FROM f WHERE i > 0 GROUP BY shape"""

#: What a turn is called, and its words with and without a street's name.
PHRASES = {
    "straight": ("continue", "Continue on <NAME>.", "Continue."),
    "slight_right": ("slight_right", "Bear right onto <NAME>.", "Bear right."),
    "right": ("right", "Turn right onto <NAME>.", "Turn right."),
    "sharp_right": ("sharp_right", "Make a sharp right onto <NAME>.", "Make a sharp right."),
    "reverse": ("uturn", "Make a U-turn onto <NAME>.", "Make a U-turn."),
    "sharp_left": ("sharp_left", "Make a sharp left onto <NAME>.", "Make a sharp left."),
    "left": ("left", "Turn left onto <NAME>.", "Turn left."),
    "slight_left": ("slight_left", "Bear left onto <NAME>.", "Bear left."),
}
#: From one edge of the lattice to the next, headings off the axes by a few degrees; streets of class 7 have no name.
CORNERS = "corners AS (SELECT a.eid AS e1, b.eid AS e2, (a.heading + a.eid * 7 % 40) % 360 AS h1, (b.heading + b.eid * 11 % 40) % 360 AS h2, CASE WHEN b.road_class = 7 THEN NULL ELSE 'Street ' || CAST(b.grade AS VARCHAR(9)) END AS name FROM edges a JOIN edges b ON b.u = a.v)"


def turn_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:  # NAR3, NAR6
    """The kind of each turn from its degrees, and its words from a small table of phrases."""
    rows = derive.run(spark, sf_dir, f"WITH {EDGES}, {CORNERS} SELECT e1, e2, name, {turn_type(turn_degree('h1', 'h2'))} AS turn FROM corners")
    words = spark.createDataFrame([(k, *v) for k, v in PHRASES.items()], "turn string, type string, named string, plain string")
    text = F.when(F.col("name").isNull(), F.col("plain")).otherwise(F.replace("named", F.lit("<NAME>"), F.col("name")))
    return rows.join(F.broadcast(words), "turn").select("e1", "e2", "type", text.alias("instruction"))


_RANGES = ((0, 10, "straight"), (11, 44, "slight_right"), (45, 135, "right"), (136, 159, "sharp_right"), (160, 200, "reverse"), (201, 224, "sharp_left"), (225, 315, "left"), (316, 349, "slight_left"), (350, 359, "straight"))
TURN_SQL = f"""WITH {EDGES}, {CORNERS}, k(lo, hi, type, verb) AS (VALUES {', '.join(f"({a}, {b}, '{PHRASES[t][0]}', '{PHRASES[t][1].removesuffix(' <NAME>.')}')" for a, b, t in _RANGES)}), d AS (SELECT *, CASE WHEN h2 < h1 THEN h2 - h1 + 360 ELSE h2 - h1 END AS deg FROM corners)
 SELECT e1, e2, type, CASE WHEN name IS NULL THEN regexp_replace(verb, ' (onto|on)$', '') ELSE concat(verb, ' ', name) END || '.' AS instruction FROM d JOIN k ON deg BETWEEN lo AND hi"""

MOST_PLACES, MOST_METRES = 6, 9000


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT21
    """A tour over the places of an order: 150 where it has too many, else 154 where a leg is too long, else 0."""
    rows = derive.run(spark, sf_dir, f"WITH {LINES} SELECT l_orderkey AS tour, l_linenumber AS k, p % 50 AS x, {idiv('p', 50)} AS y FROM lines")
    order = Window.partitionBy("tour").orderBy("k")
    leg = 100 * (F.abs(F.col("x") - F.lag("x").over(order)) + F.abs(F.col("y") - F.lag("y").over(order)))
    found = rows.withColumn("leg", leg).groupBy("tour").agg(F.count("*").alias("places"), F.coalesce(F.max("leg"), F.lit(0)).alias("metres"))
    return found.withColumn("code", F.when(F.col("places") > MOST_PLACES, 150).when(F.col("metres") > MOST_METRES, 154).otherwise(0))


LIMITS_SQL = f"""WITH {LINES}, q AS (SELECT l_orderkey AS tour, list(p ORDER BY l_linenumber) AS p FROM lines GROUP BY 1), m AS (SELECT tour, len(p) AS places,
 coalesce(list_max(list_transform(range(1, len(p)), lambda i: 100 * (abs(p[i] % 50 - p[i + 1] % 50) + abs(p[i] // 50 - p[i + 1] // 50)))), 0) AS metres FROM q)
 SELECT tour, places, metres, CASE WHEN places > {MOST_PLACES} THEN 150 ELSE CASE WHEN metres > {MOST_METRES} THEN 154 ELSE 0 END END AS code FROM m"""


def transit_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT18
    """Departures of a stop that aren't of an excluded line, from an excluded stop, or of a line outside the operators asked for."""
    rows = derive.run(spark, sf_dir, f"WITH {DEPARTURES} SELECT line_id, stop FROM departures")
    lines = derive.run(spark, sf_dir, "SELECT s_suppkey AS line_id, s_nationkey AS operator FROM supplier WHERE s_acctbal >= 0")
    stops = derive.run(spark, sf_dir, "SELECT p_partkey AS stop FROM part WHERE p_size = 13")
    kept = rows.join(lines.where(F.col("operator").isin(*range(15))), "line_id").join(stops, "stop", "left_anti")
    return kept.groupBy("stop").agg(F.count("*").alias("departures"), F.count_distinct("line_id").alias("lines"))


EXCLUDED_SQL = f"""WITH {DEPARTURES}, d AS (SELECT * FROM departures x WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = x.line_id AND s.s_acctbal < 0) AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = x.line_id AND s.s_nationkey < 15))
 SELECT d.stop, count(*) AS departures, count(DISTINCT d.line_id) AS lines FROM d JOIN part p ON p.p_partkey = d.stop WHERE p.p_size <> 13 GROUP BY d.stop"""


def transit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:  # ETL24
    """How many trips break a rule: times that don't rise, a stop twice, a single stop, stops or lines that are unknown."""
    rows = derive.run(spark, sf_dir, f"WITH {DEPARTURES} SELECT * FROM departures")
    known = derive.run(spark, sf_dir, "SELECT p_partkey AS stop, true AS known FROM part")
    lines = derive.run(spark, sf_dir, "SELECT s_suppkey AS line_id, true AS run FROM supplier WHERE s_acctbal >= 0")
    order = Window.partitionBy("trip").orderBy("seq", "dep")
    rows = rows.join(known, "stop", "left").join(lines, "line_id", "left").withColumn("falls", F.coalesce(F.lag("dep").over(order) >= F.col("dep"), F.lit(False)))
    trips = rows.groupBy("trip").agg(F.max("falls").alias("falling"), (F.count_distinct("stop") < F.count("*")).alias("twice"), (F.count("*") == 1).alias("single"), F.max(F.col("known").isNull()).alias("no_stop"), F.max(F.col("run").isNull()).alias("no_line"))
    kinds = ("falling", "twice", "single", "no_stop", "no_line")
    counts = trips.agg(*(F.count_if(k).alias(k) for k in kinds))
    return counts.select(F.explode(F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k))))).alias("rule", "trips"))


CHECKS_SQL = f"""WITH {DEPARTURES}, d AS MATERIALIZED (SELECT * FROM departures), t AS (SELECT trip, list(dep ORDER BY seq, dep) AS deps, list(stop) AS stops FROM d GROUP BY trip)
 SELECT 'falling' AS rule, count(*) AS trips FROM t WHERE len(list_filter(range(1, len(deps)), lambda i: deps[i] >= deps[i + 1])) > 0
 UNION ALL SELECT 'twice', count(*) FROM t WHERE len(list_distinct(stops)) < len(stops) UNION ALL SELECT 'single', count(*) FROM t WHERE len(stops) = 1
 UNION ALL SELECT 'no_stop', count(DISTINCT trip) FROM d WHERE stop NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'no_line', count(DISTINCT trip) FROM d WHERE line_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"""

PROGRAMS = {
    "side_of_street": (side_of_street, SIDE_SQL),
    "node_access_filter": (node_access, NODE_SQL),
    "trace_thinning": (trace_thinning, THIN_SQL),
    "trace_interpolation": (trace_interpolation, BETWEEN_SQL),
    "trace_ends": (trace_ends, ENDS_SQL),
    "admin_runs": (admin_runs, ADMIN_SQL),
    "second_pass_routes": (second_pass, PASS_SQL),
    "node_order": (node_order, ORDER_SQL),
    "country_access": (country_access, COUNTRY_SQL),
    "elevation_offsets": (elevation_offsets, OFFSETS_SQL),
    "turn_instructions": (turn_instructions, TURN_SQL),
    "request_limits": (request_limits, LIMITS_SQL),
    "transit_exclusions": (transit_exclusions, EXCLUDED_SQL),
    "transit_checks": (transit_checks, CHECKS_SQL),
}
QUERIES = {name: f for name, (f, _) in PROGRAMS.items()}
ORACLES = {name: sql for name, (_, sql) in PROGRAMS.items()}
