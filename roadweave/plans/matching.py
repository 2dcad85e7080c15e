"""Map matching, tours and elevation. Sequential steps run on one bounded trace chunk, tour or shape at a time; the DuckDB twins are recursions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import shapes as S
from roadweave.plans import catalog, derive
from roadweave.plans.catalog import POINTS as PLACES
from roadweave.plans.catalog import SEARCH_RADIUS, SEGMENTS, _EMISSION, to_segments
from roadweave.plans.derive import EDGES, HOPS, NODES, TRACES, idiv
from roadweave.plans.shapes import POINTS, fix, shapes, whole

BETA_MILLI, BREAK = 3, 2000  # fixed values: transition scale, and metres beyond which no route is looked for
CHUNK = 16
#: Points with their trace, and the edges that each may lie on; costs are whole thousandths.
TRACE = f"SELECT event_id, user_id * 1000000 + {idiv('seq - 1', CHUNK)} AS trace, CAST((seq - 1) % {CHUNK} AS BIGINT) AS i, x, y FROM traces"


def match(pdf: pd.DataFrame) -> list[tuple]:
    """(i, eid, cost, fresh) of the best sequence of edges: emission and |route - straight| / beta added up and minimised.

    Where no transition from the column before is allowed the column starts afresh with its emissions.
    """
    columns = [(i, list(own.itertuples(index=False))) for i, own in pdf.sort_values(["i", "eid"]).groupby("i", sort=True)]
    best: list[dict[int, tuple[int, int | None]]] = []
    for k, (_, column) in enumerate(columns):
        now: dict[int, tuple[int, int | None]] = {}
        for c in column:
            ways = []
            for p in columns[k - 1][1] if k else []:
                route = 100 * (abs(p.u % 50 - c.u % 50) + abs(p.u // 50 - c.u // 50))
                straight = 100 * max(abs(p.x - c.x), abs(p.y - c.y))
                if route <= BREAK and p.eid in best[-1]:
                    ways.append((best[-1][p.eid][0] + abs(route - straight) * 1000 // BETA_MILLI, p.eid))
            if ways:
                cost, eid = min(ways)
                now[c.eid] = (cost + c.emission, eid)
        best.append(now or {c.eid: (c.emission, None) for c in column})
    out: list[tuple] = []
    eid = None
    for k in range(len(columns) - 1, -1, -1):
        if eid is None:
            eid = min((cost, e) for e, (cost, _) in best[k].items())[1]
        cost, before = best[k][eid]
        out.append((columns[k][0], eid, cost, before is None))
        eid = before
    return out[::-1]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.trace_candidates(spark, sf_dir)
    trace = derive.run(spark, sf_dir, f"WITH {TRACES} {TRACE}")
    return trace.join(found, "event_id").select("trace", "i", "x", "y", "eid", F.floor(F.col("eid") / 4).alias("u"), "emission")


def viterbi_match(spark: SparkSession, sf_dir: str) -> DataFrame:  # MM4, MM6, MM7, SRT4
    """The matched edge of every point that has candidates; ``fresh`` marks where a new segment starts."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in match(pdf)], columns=["trace", "i", "eid", "cost", "fresh"])

    return candidates(spark, sf_dir).groupBy("trace").applyInPandas(run, "trace long, i long, eid long, cost long, fresh boolean")


def match_costs(spark: SparkSession, sf_dir: str) -> DataFrame:  # MM3, MM8, MM9, MM11
    """Of each continuous segment of a matched trace its points and cost, and how sure the match is against its worst."""
    found = viterbi_match(spark, sf_dir)
    from pyspark.sql import Window

    piece = F.sum(F.col("fresh").cast("long")).over(Window.partitionBy("trace").orderBy("i"))
    return found.withColumn("segment", piece).groupBy("trace", "segment").agg(F.count("*").alias("points"), F.max("cost").alias("cost"))


_NEAR = f"near AS ({to_segments(f'({PLACES}) p CROSS JOIN ({SEGMENTS}) e')})"
MATCH_SQL = f"""WITH RECURSIVE {EDGES}, {TRACES}, {_NEAR}, cand AS (SELECT event_id, eid, {_EMISSION} AS emission FROM near WHERE d2 <= {SEARCH_RADIUS**2 * 1000}),
 c AS MATERIALIZED (SELECT t.trace, t.i, t.x, t.y, k.eid, k.eid // 4 AS u, k.emission, dense_rank() OVER (PARTITION BY t.trace ORDER BY t.i) AS n FROM ({TRACE}) t JOIN cand k USING (event_id)),
 v(trace, n, eid, cost, seg) AS (SELECT trace, n, eid, emission, 1 FROM c WHERE n = 1 UNION ALL
  SELECT trace, n, eid, cost, seg FROM (SELECT b.trace, b.n, b.eid, coalesce(min(CASE WHEN r.far <= {BREAK} THEN a.cost + abs(r.far - r.straight) * 1000 // {BETA_MILLI} END) + b.emission, b.emission) AS cost,
    min(CASE WHEN r.far <= {BREAK} THEN 0 ELSE 1 END) AS blocked, min(min(CASE WHEN r.far <= {BREAK} THEN 0 ELSE 1 END)) OVER (PARTITION BY b.trace) AS broken, min(a.seg) AS s0, min(a.seg) + min(min(CASE WHEN r.far <= {BREAK} THEN 0 ELSE 1 END)) OVER (PARTITION BY b.trace) AS seg
   FROM v a JOIN c p ON p.trace = a.trace AND p.n = a.n AND p.eid = a.eid JOIN c b ON b.trace = a.trace AND b.n = a.n + 1,
   LATERAL (SELECT 100 * (abs(p.u % 50 - b.u % 50) + abs(p.u // 50 - b.u // 50)) AS far, 100 * greatest(abs(p.x - b.x), abs(p.y - b.y)) AS straight) r GROUP BY b.trace, b.n, b.eid, b.emission) z WHERE blocked = broken),
 col AS (SELECT trace, n, seg, min(cost) AS cost FROM v GROUP BY ALL)
 SELECT trace, seg AS segment, count(*) AS points, CAST(arg_max(cost, n) AS BIGINT) AS cost FROM col GROUP BY trace, seg"""


def tour(stops: list[int]) -> tuple[list[int], int]:
    """The cheapest order of stops with the first and the last kept in place, by dynamic programming over subsets."""
    gap = lambda a, b: abs(a // 50 - b // 50) + abs(a % 50 - b % 50)
    inner = list(range(1, len(stops) - 1))
    state = {(0, 0): (0, ())}
    for _ in inner:
        after: dict[tuple[int, int], tuple[int, tuple]] = {}
        for (mask, last), (cost, path) in state.items():
            for k in inner:
                if not mask >> k & 1:
                    key, made = (mask | 1 << k, k), (cost + gap(stops[last], stops[k]), (*path, k))
                    if key not in after or made < after[key]:
                        after[key] = made
        state = after
    ends = [(cost + gap(stops[last], stops[-1]), path) for (_, last), (cost, path) in state.items()] if len(stops) > 1 else [(0, ())]
    cost, path = min(ends)
    return [stops[0], *(stops[k] for k in path), *stops[1:][-1:]], cost


def optimized_tour(spark: SparkSession, sf_dir: str) -> DataFrame:  # GRF15, AGG12
    """The best order of the stops of each order, which has at most seven; the first and the last stay."""
    rows = derive.run(spark, sf_dir, f"WITH {HOPS} SELECT l_orderkey, l_linenumber, p FROM lines")
    stops = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))), lambda s: s["p"]).alias("stops"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(cost=[tour(list(s))[1] for s in pdf["stops"]], stops=[len(s) for s in pdf["stops"]])[["l_orderkey", "stops", "cost"]]

    return stops.mapInPandas(run, "l_orderkey long, stops long, cost long")


TOUR_SQL = f"""WITH RECURSIVE {HOPS}, s AS MATERIALIZED (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lines),
 w(l_orderkey, n, spot, mask, cost) AS (SELECT l_orderkey, n, p, 1, 0 FROM s WHERE k = 1 UNION ALL SELECT w.l_orderkey, w.n, s.p, w.mask | (1 << (s.k - 1)), w.cost + abs({idiv('w.spot', 50)} - {idiv('s.p', 50)}) + abs(w.spot % 50 - s.p % 50)
  FROM w JOIN s ON s.l_orderkey = w.l_orderkey AND (w.mask >> (s.k - 1)) & 1 = 0 AND (s.k < w.n OR bit_count(w.mask) = w.n - 1))
 SELECT l_orderkey, n AS stops, CAST(min(cost) AS BIGINT) AS cost FROM w WHERE bit_count(mask) = n GROUP BY l_orderkey, n"""

NO_DATA = -32768
HEIGHTS = f"heights AS (SELECT r, c, CASE WHEN gid % 17 = 0 THEN {NO_DATA} ELSE gid * 37 % 211 - 20 END AS h FROM nodes)"


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear heights at the points of all shapes: corners without data weigh nothing, the others are weighed anew."""
    points = derive.run(spark, sf_dir, f"WITH {POINTS} SELECT shape, i, (x - 5.0E0) * 1000 AS x, (y - 52.0E0) * 1000 AS y FROM p")
    heights = derive.run(spark, sf_dir, f"WITH {NODES}, {HEIGHTS} SELECT r, c, h FROM heights WHERE h <> {NO_DATA}")
    corner = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1))))
    near = points.withColumn("k", corner).withColumns({"r": F.floor("y") + F.col("k.dr"), "c": F.floor("x") + F.col("k.dc")})
    weight = F.abs(1 - F.col("k.dr") - (F.col("y") - F.floor("y"))) * F.abs(1 - F.col("k.dc") - (F.col("x") - F.floor("x")))
    found = near.join(heights, ["r", "c"], "left").withColumn("w", F.when(F.col("h").isNotNull(), weight).otherwise(0.0))
    return found.groupBy("shape", "i").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.coalesce("h", F.lit(0))), F.sum("w")), F.lit(float(NO_DATA))).alias("height"))


def height_profile(spark: SparkSession, sf_dir: str) -> DataFrame:  # ELV1, ELV2, SNK6
    """(shape, i, height, range): heights in tenths of a metre, and metres along the shape."""
    ranges = shapes(spark, sf_dir).select("shape", F.posexplode(S.let(F.col("pts"), lambda p: F.transform(p, lambda _, i: S.length(F.slice(p, 1, i + 1))))).alias("i", "m"))
    return elevations(spark, sf_dir).join(ranges, ["shape", "i"]).select("shape", F.col("i").cast("long").alias("i"), whole(F.col("height") + 1e-7, 10).alias("height"), whole(F.col("m"), 10).alias("range"))


def _profile_sql() -> str:
    from roadweave.plans.shapes import SEG

    corners = " ".join(f"LEFT JOIN g g{a}{b} ON g{a}{b}.r = f.r0 + {a} AND g{a}{b}.c = f.c0 + {b}" for a in (0, 1) for b in (0, 1))
    weight = {(a, b): f"(CASE WHEN g{a}{b}.h IS NULL THEN 0.0::DOUBLE ELSE ({'fy' if a else '1 - fy'}) * ({'fx' if b else '1 - fx'}) END)" for a in (0, 1) for b in (0, 1)}
    up, down = " + ".join(f"{w} * coalesce(g{a}{b}.h, 0)" for (a, b), w in weight.items()), " + ".join(weight.values())
    return f"""{SEG}, {NODES}, {HEIGHTS}, g AS (SELECT * FROM heights WHERE h <> {NO_DATA}), f AS (SELECT shape, i, CAST(floor((x - 5.0E0) * 1000) AS BIGINT) AS c0, CAST(floor((y - 52.0E0) * 1000) AS BIGINT) AS r0, (x - 5.0E0) * 1000 - floor((x - 5.0E0) * 1000) AS fx, (y - 52.0E0) * 1000 - floor((y - 52.0E0) * 1000) AS fy FROM q),
 e AS (SELECT f.shape, f.i, CASE WHEN {down} = 0 THEN {NO_DATA}::DOUBLE ELSE ({up}) / ({down}) END AS h FROM f {corners}), run AS (SELECT shape, i + 1 AS i, sum(m) OVER (PARTITION BY shape ORDER BY i) AS m FROM seg)
 SELECT e.shape, CAST(e.i AS BIGINT) AS i, {fix('(h + 1e-7)', '10')} AS height, {fix('coalesce(run.m, 0)', '10')} AS range FROM e LEFT JOIN run ON run.shape = e.shape AND run.i = e.i"""


def grades(heights, interval: float, weigh=None):
    """struct<weighted, up, down, mean> of an array of heights at equal steps; steps at places without data are level.

    ``weigh(grade)`` gives a grade's weight, by default more for climbs than for descents of -10 to 15 percent.
    """
    weigh = weigh or (lambda g: 1 + g / F.when(g > 0, 7.0).otherwise(17.0))
    good = lambda h: h != NO_DATA
    step = lambda a, b: F.when(good(a) & good(b), (b - a) * (100 / interval)).otherwise(0.0)
    raw = F.transform(F.sequence(F.lit(1), F.size(heights) - 1), lambda i: step(F.get(heights, i - 1), F.get(heights, i)))

    def of(g):
        kept = F.transform(g, lambda x: F.greatest(F.lit(-10.0), F.least(F.lit(15.0), x)))
        known = F.filter(heights, good)
        return F.struct((S.total(F.transform(kept, lambda x: x * weigh(x))) / S.total(F.transform(kept, weigh))).alias("weighted"), F.greatest(F.lit(0.0), F.array_max(g)).alias("up"), F.least(F.lit(0.0), F.array_min(g)).alias("down"), F.coalesce(F.try_divide(S.total(known), F.size(known)), F.lit(float(NO_DATA))).alias("mean"))

    return S.let(raw, of)


GROUND = f"WITH {HOPS} SELECT l_orderkey, l_linenumber, CASE WHEN p % 17 = 0 THEN {NO_DATA}.0E0 ELSE CAST(p * 37 % 31 AS DOUBLE) END AS h FROM lines"


def weighted_grade(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG5, EXT6
    rows = derive.run(spark, sf_dir, GROUND)
    h = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "h"))), lambda s: s["h"])
    found = rows.groupBy("l_orderkey").agg(h.alias("h")).where(F.size("h") >= 2).select("l_orderkey", grades(F.col("h"), 60.0).alias("g"))
    return found.select("l_orderkey", *(whole(F.col(f"g.{k}") + 1e-7, 1000).alias(k) for k in ("weighted", "up", "down", "mean")))


GRADE_SQL = f"""WITH b AS ({GROUND}), l AS (SELECT *, lag(h) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS h0 FROM b), g AS (SELECT *, CASE WHEN h0 IS NULL THEN NULL WHEN h = {NO_DATA} OR h0 = {NO_DATA} THEN 0.0 ELSE (h - h0) / 0.6::DOUBLE END AS raw FROM l),
 k AS (SELECT *, CASE WHEN raw > 15 THEN 15.0 WHEN raw < -10 THEN -10.0 ELSE raw END AS cut FROM g), w AS (SELECT *, CASE WHEN cut > 0 THEN 1 + cut / 7 ELSE 1 + cut / 17 END AS weight FROM k)
 SELECT l_orderkey, {fix('(sum(cut * weight) / sum(weight) + 1e-7)', '1000')} AS weighted, {fix('(greatest(0, max(raw)) + 1e-7)', '1000')} AS up, {fix('(least(0, min(raw)) + 1e-7)', '1000')} AS down, {fix(f'(coalesce(avg(CASE WHEN h <> {NO_DATA} THEN h END), {NO_DATA}) + 1e-7)', '1000')} AS mean FROM w GROUP BY l_orderkey HAVING count(*) >= 2"""

QUERIES = {f.__name__: f for f in (viterbi_match, match_costs, optimized_tour, height_profile, weighted_grade)}
ORACLES = {"match_costs": MATCH_SQL, "optimized_tour": TOUR_SQL, "height_profile": _profile_sql(), "weighted_grade": GRADE_SQL}
