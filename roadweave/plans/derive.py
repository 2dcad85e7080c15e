"""Network tables derived from the star-schema tables, as common table expressions that Spark SQL and DuckDB both run.

Nodes are parts on a lattice of 50 columns, with integer attributes; edges lead to the four neighbours; hops are consecutive
parts of an order; traces are the events of a user; departures are order lines by supplier. All costs are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH = 50
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def idiv(a: str, b: str | int) -> str:
    return f"CAST(floor(({a}) / ({b})) AS BIGINT)"


NODES = f"""nodes AS (SELECT p_partkey AS gid, {idiv("p_partkey", WIDTH)} AS r, p_partkey % {WIDTH} AS c, CAST(p_size AS BIGINT) AS size,
  5.0E0 + (p_partkey % {WIDTH}) * 0.001E0 AS lon, 52.0E0 + {idiv("p_partkey", WIDTH)} * 0.001E0 AS lat,
  p_partkey % 16 AS density, p_partkey % 5 AS node_type, CAST(length(p_name) AS BIGINT) AS name_len FROM part)"""

_STEP = "SELECT a.gid AS u, b.gid AS v, CAST({d} AS BIGINT) AS dir, a.size AS size, b.size AS size_v, a.density AS density, a.lon AS lon_u, a.lat AS lat_u, b.lon AS lon_v, b.lat AS lat_v FROM nodes a JOIN nodes b ON b.gid = a.gid + {o} AND b.r = a.r + {dr}"
EDGES = (
    NODES
    + ", steps AS ("
    + " UNION ALL ".join(_STEP.format(d=d, o=o, dr=dr) for d, o, dr in ((0, 1, 0), (1, WIDTH, 1), (2, -1, 0), (3, -WIDTH, -1)))
    + f"""), edges AS (SELECT u * 4 + dir AS eid, u, v, dir, size, size_v, density, lon_u, lat_u, lon_v, lat_v, CAST(100 AS BIGINT) AS length_m, 20 + size AS speed, {idiv("360000", "20 + size")} AS cost_ms,
  (u * 3 + dir) % 8 AS road_class, (u + dir * 5) % 7 AS surface, (u * 13 + dir * 5) % 16 AS grade, (u * 7 + dir * 3) % 11 AS rule,
  CASE WHEN (u * 7 + dir * 3) % 11 = 0 THEN 2 WHEN (u * 7 + dir * 3) % 11 = 1 THEN 6 ELSE 1 + 2 + 4 + 8 END AS access,
  CASE WHEN (u + dir) % 17 = 0 THEN 1 ELSE 0 END AS toll, CASE WHEN (u * 5 + dir) % 23 = 0 THEN 1 ELSE 0 END AS tunnel,
  CASE WHEN (u * 5 + dir) % 29 = 0 THEN 1 ELSE 0 END AS bridge, 90 * ((1 - dir + 4) % 4) AS heading FROM steps)"""
)
HOPS = """lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
 steps_h AS (SELECT p AS u, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS v, q FROM lines),
 hops AS (SELECT u, v, CAST(sum(q) AS BIGINT) AS w, count(*) AS n FROM steps_h WHERE v IS NOT NULL AND u <> v GROUP BY u, v)"""
TRACES = """traces AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CAST(floor(value * 100) AS BIGINT) % 50 AS x, CAST(floor(value * 100 / 50) AS BIGINT) % 40 AS y, event_type FROM events)"""
DEPARTURES = """departures AS (SELECT l_suppkey AS line_id, (l_orderkey * 37 + l_linenumber * 613) % 86400 AS dep, l_partkey AS stop, l_orderkey AS trip, l_linenumber AS seq,
  l_orderkey % 127 AS days FROM lineitem)"""


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(sql)
