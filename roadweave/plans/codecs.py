"""Queries on codings, speeds, names and times. The DuckDB twins work on rows, or on the parts that a text was built from."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import codecs as C
from roadweave.functions import shapes as S
from roadweave.plans import derive
from roadweave.plans.derive import EDGES
from roadweave.plans.shapes import Q, fix, shapes, whole

STREETS = """names AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'North' WHEN 1 THEN 'SW' ELSE '' END AS prefix,
 concat('Street', CAST(p_partkey % 37 AS VARCHAR(9)), CASE WHEN p_partkey % 5 = 0 THEN ' Old Road' ELSE ' Avenue' END) AS base, CASE p_partkey % 3 WHEN 0 THEN 'East' ELSE '' END AS suffix FROM part)"""
NAMED = f"WITH {STREETS} SELECT id, prefix, base, suffix, concat(CASE WHEN prefix = '' THEN '' ELSE concat(prefix, ' ') END, base, CASE WHEN suffix = '' THEN '' ELSE concat(' ', suffix) END) AS name FROM names"
HOURS = """rules AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS INT) AS d0, CAST(floor(o_orderkey / 7) % 7 AS INT) AS d1, CAST(o_custkey % 24 AS INT) AS h0, CAST(floor(o_custkey / 24) % 24 AS INT) AS h1, CAST(o_orderkey % 60 AS INT) AS m0,
 CAST(o_custkey % 7 AS INT) AS day, CAST(o_orderkey * 13 % 1440 AS INT) AS minute FROM orders)"""
WEEK = "CASE {d} WHEN 0 THEN 'Su' WHEN 1 THEN 'Mo' WHEN 2 THEN 'Tu' WHEN 3 THEN 'We' WHEN 4 THEN 'Th' WHEN 5 THEN 'Fr' ELSE 'Sa' END"
SPAN = " + ".join(f"(CASE WHEN (({k} - d0 + 7) % 7) <= ((d1 - d0 + 7) % 7) THEN {1 << k} ELSE 0 END)" for k in range(7))
UNITS = "SELECT p_partkey AS id, CAST(p_partkey % 90 + 5 AS INT) AS n, CAST(p_partkey % 4 AS INT) AS k FROM part"


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR1, STR2, SRC16
    p = F.col("pts")
    return shapes(spark, sf_dir).select("shape", C.encode_polyline(p, 6).alias("six"), C.encode_polyline(p, 5).alias("five"), F.hex(C.encode7(p, 6)).alias("seven"))


def round_trip(decoded):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = shapes(spark, sf_dir).select("shape", F.posexplode(decoded(F.col("pts"))).alias("i", "q"))
        return found.select("shape", F.col("i").cast("long").alias("i"), whole(F.col("q.x"), 1e6).alias("x"), whole(F.col("q.y"), 1e6).alias("y"))

    return query


def _encoded(digits: int, bits: int, char: str, empty: str) -> str:
    return f"""(SELECT shape, string_agg({char}, '{empty}' ORDER BY i, axis, k) AS t FROM (SELECT shape, i, axis, k, (z >> ({bits} * k)) & {(1 << bits) - 1} AS part, (z >> ({bits} * (k + 1))) > 0 AS more, (z >> ({bits} * k)) > 0 OR k = 0 AS used
  FROM (SELECT shape, i, axis, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS z, unnest(range(0, 9)) AS k FROM (SELECT shape, i, 0 AS axis, r{digits}y - coalesce(lag(r{digits}y) OVER w, 0) AS d FROM r WINDOW w AS (PARTITION BY shape ORDER BY i) UNION ALL SELECT shape, i, 1, r{digits}x - coalesce(lag(r{digits}x) OVER w, 0) FROM r WINDOW w AS (PARTITION BY shape ORDER BY i)) s) u) v WHERE used GROUP BY shape)"""


ROUNDED = f"{Q}, r AS (SELECT shape, i, CAST(round(x * 1e6) AS BIGINT) AS r6x, CAST(round(y * 1e6) AS BIGINT) AS r6y, CAST(round(x * 1e5) AS BIGINT) AS r5x, CAST(round(y * 1e5) AS BIGINT) AS r5y FROM q)"
_FIVE = "chr(CAST(part + 63 + CASE WHEN more THEN 32 ELSE 0 END AS INTEGER))"
POLYLINES = f"{ROUNDED} SELECT a.shape, a.t AS six, b.t AS five, c.t AS seven FROM {_encoded(6, 5, _FIVE, '')} a JOIN {_encoded(5, 5, _FIVE, '')} b USING (shape) JOIN {_encoded(6, 7, 'printf(' + chr(39) + '%02X' + chr(39) + ', part + CASE WHEN more THEN 128 ELSE 0 END)', '')} c USING (shape)"
_POINTS = f"{ROUNDED} SELECT shape, CAST(i AS BIGINT) AS i, r6x AS x, r6y AS y FROM r"


def week_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPD2, SRC7, ETL17
    """A week of made-up speeds of each nation, compressed, coded, decoded and evaluated at some bucket."""
    rows = derive.run(spark, sf_dir, "SELECT n_nationkey AS edge FROM nation")
    speeds = F.transform(F.sequence(F.lit(0), F.lit(C.BUCKETS - 1)), lambda b: 30.0 + (b * 7 + F.col("edge") * 13) % 97 + F.when((b % 288 > 84) & (b % 288 < 228), -15.0).otherwise(0.0))
    coded = rows.select("edge", C.encode_speeds(C.compress_speeds(speeds)).alias("text"))
    got = F.floor(F.greatest(C.speed_at(C.decode_speeds(F.col("text")), F.col("edge") * 80), F.lit(0.5)) + 0.5)
    return coded.select("edge", "text", got.cast("long").alias("kmh"))


WEEKS = """WITH s AS (SELECT n_nationkey AS edge, b, 30.0::DOUBLE + (b * 7 + n_nationkey * 13) % 97 + CASE WHEN b % 288 > 84 AND b % 288 < 228 THEN -15.0::DOUBLE ELSE 0 END AS v FROM nation, range(0, 2016) t(b)),
 k AS (SELECT edge, c, CAST(round(sum(v * cos(pi() / 2016 * (b + 0.5::DOUBLE) * c)) * sqrt(2::DOUBLE / 2016) * CASE WHEN c = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END) AS BIGINT) AS v FROM s, range(0, 200) u(c) GROUP BY edge, c)
 SELECT edge, base64(unhex(string_agg(printf('%04X', v & 65535), '' ORDER BY c))) AS text,
 CAST(floor(greatest(0.5, sum(v * cos(pi() / 2016 * (edge * 80 + 0.5::DOUBLE) * c) * CASE WHEN c = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END) * sqrt(2::DOUBLE / 2016)) + 0.5) AS BIGINT) AS kmh FROM k GROUP BY edge"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:  # DAT8, DAT1
    day = lambda c: F.element_at(F.array(*(F.lit(d) for d in C.DAYS)), F.col(c) + 1)
    rows = derive.run(spark, sf_dir, f"WITH {HOURS} SELECT * FROM rules")
    text = F.concat(day("d0"), F.lit("-"), day("d1"), F.format_string(" %02d:%02d-%02d:00", "h0", "m0", "h1"))
    rows = rows.withColumn("r", C.opening_hours(text))
    return rows.select("id", F.col("r")[0]["days"].cast("long").alias("days"), F.col("r")[0]["start"].cast("long").alias("start"), F.col("r")[0]["end"].cast("long").alias("stop"), C.open_at(F.col("r"), F.col("day"), F.col("minute")).cast("int").alias("open"))


_DAY_ON = "(((({d}) - d0 + 14) % 7) <= ((d1 - d0 + 7) % 7))"
HOURS_SQL = f"""WITH {HOURS} SELECT id, CAST({SPAN} AS BIGINT) AS days, CAST(h0 * 60 + m0 AS BIGINT) AS start, CAST(h1 * 60 AS BIGINT) AS stop,
 CASE WHEN {_DAY_ON.format(d='day')} AND minute >= h0 * 60 + m0 AND (minute < h1 * 60 OR h1 * 60 < h0 * 60 + m0) THEN 1 WHEN {_DAY_ON.format(d='day - 1')} AND h1 * 60 < h0 * 60 + m0 AND minute < h1 * 60 THEN 1 ELSE 0 END AS open FROM rules"""


def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR4, STR6, STR7, SET2, SET7
    rows = derive.run(spark, sf_dir, NAMED).withColumn("p", C.street_parts(F.col("name")))
    quoted = F.regexp_replace(F.concat(F.lit('"'), "name", F.lit('"')), '"', "")
    return rows.select("id", "p.prefix", "p.base", "p.suffix", C.joined_names(F.split(quoted, " "), "/", 3).alias("joined"), F.size(F.split("name", " ")).cast("long").alias("words"))


STREETS_SQL = f"WITH a AS ({NAMED}) SELECT id, prefix, base, suffix, array_to_string(string_split(name, ' ')[1:3], '/') AS joined, CAST(length(name) - length(replace(name, ' ', '')) + 1 AS BIGINT) AS words FROM a"


def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:  # SET2, STR15, ETL22
    """Base names that an edge's street shares with the next one's, and the deduplicated name table's size."""
    rows = derive.run(spark, sf_dir, NAMED).select("id", F.array("base", "prefix").alias("own"), F.array(F.concat("base"), F.lit("SW")).alias("other"))
    shared = F.array_sort(F.array_intersect("own", "other"))
    return rows.groupBy(F.array_join(shared, ";").alias("shared")).agg(F.count("*").alias("n"))


COMMON_SQL = f"WITH a AS ({NAMED}) SELECT CASE WHEN prefix = 'SW' THEN array_to_string(list_sort([base, prefix]), ';') ELSE base END AS shared, count(*) AS n FROM a GROUP BY 1"


def tagged_units(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR11, SRC4, ETL1
    rows = derive.run(spark, sf_dir, UNITS)
    n = F.col("n").cast("string")
    pick = lambda *texts: F.element_at(F.array(*texts), F.col("k") + 1)
    speed = pick(n, F.concat(n, F.lit(" mph")), F.lit("none"), F.concat(n, F.lit(" knots")))
    weight = pick(F.concat(n, F.lit(".5")), F.concat(n, F.lit("00 kg")), F.concat(n, F.lit(" st")), F.concat(n, F.lit("000 lbs")))
    high = pick(F.concat(n, F.lit(".25")), F.concat(n, F.lit("'6\"")), F.concat(n, F.lit("0 cm")), F.concat(n, F.lit(" ft")))
    return rows.select("id", C.kmh(speed).cast("long").alias("kmh"), whole(C.tonnes(weight) + 1e-7, 1000).alias("kg"), whole(C.tagged_metres(high) + 1e-7, 1000).alias("mm"))


UNITS_SQL = f"""SELECT id, CAST(CASE k WHEN 0 THEN n WHEN 1 THEN floor(n * 1.609344 + 0.5) WHEN 2 THEN 140 ELSE floor(n * 1.852 + 0.5) END AS BIGINT) AS kmh,
 {fix('CASE k WHEN 0 THEN n + 0.5 WHEN 1 THEN n * 0.1 WHEN 2 THEN n * 0.90718474 ELSE n * 0.45359237 END + 1e-7', '1000')} AS kg,
 {fix('CASE k WHEN 0 THEN n + 0.25 WHEN 1 THEN n * 0.3048 + 6 * 0.0254 WHEN 2 THEN n * 0.1 ELSE n * 0.3048 END + 1e-7', '1000')} AS mm FROM ({UNITS}) u"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR5, STR9, STR14
    rows = derive.run(spark, sf_dir, "SELECT p_partkey AS id, p_partkey * 7 % 2600 AS metres, 100 + p_partkey % 900 AS route FROM part")
    said = C.verbal_ref(F.concat(F.lit("I "), F.col("route").cast("string")))
    marked = F.replace(F.replace(F.lit("<a><b/></a>"), F.lit("<b/>"), said), F.lit("a>"), F.lit("say>"))
    return rows.select("id", C.length_phrase(F.col("metres").cast("double")).alias("length"), said.alias("said"), marked.alias("marked"))


_SAID = "'Interstate ' || CASE WHEN route // 10 % 10 = 0 THEN (route // 100) || ' oh ' || (route % 10) ELSE (route // 100) || ' ' || (route % 100) END"
PHRASES_SQL = f"""WITH r AS (SELECT p_partkey AS id, p_partkey * 7 % 2600 AS metres, 100 + p_partkey % 900 AS route FROM part)
 SELECT id, CASE WHEN metres < 10 THEN 'less than 10 meters' WHEN metres < 995 THEN ((metres + 5) // 10 * 10) || ' meters' WHEN metres < 1250 THEN '1 kilometer' ELSE CASE WHEN (metres + 250) // 500 % 2 = 0 THEN '' || ((metres + 250) // 1000) ELSE ((metres + 250) // 1000) || '.5' END || ' kilometers' END AS length,
 {_SAID} AS said, '<say>' || {_SAID} || '</say>' AS marked FROM r"""


def level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR10, FLT14
    rows = derive.run(spark, sf_dir, "SELECT p_partkey AS id, CAST(p_partkey % 5 - 2 AS INT) AS a, CAST(p_partkey % 3 AS INT) AS b FROM part")
    text = F.concat(F.col("a").cast("string"), F.lit(";"), F.col("b").cast("string"), F.lit("-"), (F.col("b") + 2).cast("string"), F.lit(";x"))
    found = rows.withColumn("l", C.levels(text))
    hit = F.exists("l", lambda r: (r["low"] <= 1) & (r["high"] >= 1))
    return found.select("id", F.size("l").cast("long").alias("ranges"), F.aggregate("l", F.lit(0.0), lambda s, r: s + r["high"] - r["low"]).cast("long").alias("span"), hit.cast("int").alias("on_level_1"))


LEVELS_SQL = "WITH r AS (SELECT p_partkey AS id, p_partkey % 5 - 2 AS a, p_partkey % 3 AS b FROM part) SELECT id, CAST(2 AS BIGINT) AS ranges, CAST(2 AS BIGINT) AS span, CASE WHEN a = 1 OR b <= 1 THEN 1 ELSE 0 END AS on_level_1 FROM r"


def deflate(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else gzip.compress(t.encode(), 6, mtime=0))


def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else gzip.decompress(d).decode())


def gzip_and_base64(spark: SparkSession, sf_dir: str) -> DataFrame:  # STR3, STR13, SRC8
    pack, unpack = F.pandas_udf(deflate, "binary"), F.pandas_udf(inflate, "string")
    rows = derive.run(spark, sf_dir, "SELECT event_id, props FROM events").withColumn("packed", pack("props"))
    return rows.select("event_id", F.sha2(F.encode(unpack("packed"), "UTF-8"), 256).alias("sha"), C.one_line(F.base64(F.encode("props", "UTF-8"))).alias("text"), F.decode(F.unbase64(F.base64(F.encode("props", "UTF-8"))), "UTF-8").eqNullSafe(F.col("props")).cast("int").alias("same"))


GZIP_SQL = "SELECT event_id, sha256(props) AS sha, base64(encode(props)) AS text, 1 AS same FROM events"


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:  # DAT3, DAT4, DAT5, DAT7, DAT11
    rows = derive.run(spark, sf_dir, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events")
    berlin, york = (F.from_utc_timestamp("ts", z) for z in ("Europe/Berlin", "America/New_York"))
    seconds = lambda t: F.unix_seconds(t)
    later = F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds("ts") + 90 * 86400), "America/New_York")
    second_of_week = (F.dayofweek(later) - 1) * 86400 + F.hour(later) * 3600 + F.minute(later) * 60 + F.second(later)
    return rows.select("event_id", F.date_format(berlin, "yyyy-MM-dd'T'HH:mm").alias("berlin"), (seconds(berlin) - seconds(york)).cast("long").alias("apart"), second_of_week.cast("long").alias("second_of_week"), F.date_format(york, "HH:mm").alias("shown"))


#: The tables' times are in January and 90 days later: New York is 5 h behind UTC until the second Sunday of March, then 4 h; Berlin is 1 h ahead.
TIMES_SQL = """WITH t AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events), l AS (SELECT *, ts + INTERVAL 90 DAY AS f FROM t), n AS (SELECT *, f - CASE WHEN f >= TIMESTAMP '2024-03-10 07:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS later FROM l)
 SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M') AS berlin, CAST(21600 AS BIGINT) AS apart, CAST(dayofweek(later) * 86400 + hour(later) * 3600 + minute(later) * 60 + second(later) AS BIGINT) AS second_of_week, strftime(ts - INTERVAL 5 HOUR, '%H:%M') AS shown FROM n"""


def flow_speed(live, coverage, predicted, constrained, free, base, second, ahead):
    """struct<kmh, source>: live speed faded over an hour and over the part that it covers, the rest from the best other source.

    Sources: 8 live, 4 predicted, 2 constrained (07:00 to 19:00), 1 free flow (else), 0 the edge's own.
    """
    share = F.when(live.isNotNull() & (live > 0), coverage * (1 - F.least(ahead / 3600.0, F.lit(1.0)))).otherwise(F.lit(0.0))
    day = (second % 86400 > 25200) & (second % 86400 < 68400)
    other = F.when(predicted.isNotNull(), F.struct((F.greatest(predicted, F.lit(0.5)) + 0.5).alias("v"), F.lit(4).alias("s")))
    other = other.when(day & constrained.isNotNull(), F.struct(constrained.cast("double").alias("v"), F.lit(2).alias("s"))).when(~day & free.isNotNull(), F.struct(free.cast("double").alias("v"), F.lit(1).alias("s"))).otherwise(F.struct(base.cast("double").alias("v"), F.lit(0).alias("s")))
    mixed = lambda o: F.struct(F.floor(F.when(share >= 1, live).otherwise(F.coalesce(live, F.lit(0)) * share + (1 - share) * o["v"])).cast("long").alias("kmh"), (F.when(share >= 1, 0).otherwise(o["s"]) + F.when(share > 0, 8).otherwise(0)).cast("long").alias("source"))
    return S.let(other, mixed)


SPEEDS = f"WITH {EDGES} SELECT eid, speed, CASE WHEN eid % 4 = 0 THEN 15 + eid % 60 END AS live, CASE eid % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.5E0 ELSE 0.25E0 END AS coverage, CASE WHEN eid % 5 = 0 THEN 0.25E0 + eid % 70 END AS predicted, CASE WHEN eid % 7 < 3 THEN 20 + eid % 50 END AS constrained, CASE WHEN eid % 7 > 1 THEN 40 + eid % 50 END AS free, eid * 37 % 604800 AS second, CASE WHEN eid % 6 = 0 THEN 0 ELSE eid * 11 % 5000 END AS ahead FROM edges"


def flow_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPD1, AGG13, SRC14
    c = F.col
    return derive.run(spark, sf_dir, SPEEDS).select("eid", flow_speed(c("live"), c("coverage"), c("predicted"), c("constrained"), c("free"), c("speed"), c("second"), c("ahead")).alias("f")).select("eid", "f.*")


FLOW_SQL = f"""WITH e AS ({SPEEDS}), w AS (SELECT *, CASE WHEN live > 0 THEN greatest(0.0, 1 - ahead / 3600.0::DOUBLE) * coverage ELSE 0.0 END AS k, second % 86400 BETWEEN 25201 AND 68399 AS day FROM e),
 o AS (SELECT *, CASE WHEN predicted IS NOT NULL THEN 4 WHEN day AND constrained IS NOT NULL THEN 2 WHEN NOT day AND free IS NOT NULL THEN 1 ELSE 0 END AS s FROM w)
 SELECT eid, CAST(floor(CASE WHEN k >= 1 THEN live ELSE coalesce(live, 0) * k + (1 - k) * CASE s WHEN 4 THEN greatest(predicted, 0.5) + 0.5 WHEN 2 THEN constrained WHEN 1 THEN free ELSE speed END END) AS BIGINT) AS kmh,
 CAST(CASE WHEN k >= 1 THEN 8 WHEN k > 0 THEN 8 + s ELSE s END AS BIGINT) AS source FROM o"""


def osrm_turns(spark: SparkSession, sf_dir: str) -> DataFrame:  # CST18; fixed values: 7.5 s, bias 1.075, 2 s a signal, 20 s a U-turn
    rows = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT a.eid AS e1, b.eid AS e2, (b.heading - a.heading + 360) % 360 AS turn, a.v % 5 = 0 AS signal FROM edges a JOIN edges b ON a.v = b.u")
    angle = F.when(F.col("turn") > 180, F.col("turn") - 360).otherwise(F.col("turn"))
    bias = F.when(angle >= 0, F.lit(1 / 1.075)).otherwise(F.lit(1.075))
    turn = F.when(angle == 0, F.lit(0.0)).otherwise(7.5 / (1 + F.exp(-(13 * bias * F.abs(angle) / 180 - 6.5 / bias))))
    return rows.select("e1", "e2", whole(turn + F.when(F.col("signal"), 2.0).otherwise(0.0) + F.when(angle == 180, 20.0).otherwise(0.0), 1000).alias("ms"))


OSRM_SQL = f"""WITH {EDGES}, t AS (SELECT a.eid AS e1, b.eid AS e2, a.v, CASE WHEN a.heading = b.heading THEN 0 WHEN (b.heading - a.heading + 360) % 360 = 90 THEN 90 WHEN (b.heading - a.heading + 360) % 360 = 180 THEN 180 ELSE -90 END AS a FROM edges a JOIN edges b ON a.v = b.u)
 SELECT e1, e2, {fix("CASE a WHEN 0 THEN 0.0 ELSE 7.5 / (1 + exp(6.5 / (CASE WHEN a > 0 THEN 1 / 1.075::DOUBLE ELSE 1.075::DOUBLE END) - 13 * (CASE WHEN a > 0 THEN 1 / 1.075::DOUBLE ELSE 1.075::DOUBLE END) * abs(a) / 180)) END + CASE WHEN v % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN a = 180 THEN 20 ELSE 0 END", '1000')} AS ms FROM t"""


def ferry_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPD4, CST13, CST17
    """Speed of a way from its length and tagged duration, between 5 and 60; by length where no duration is given (10, 20, 30 km/h)."""
    rows = derive.run(spark, sf_dir, f"WITH {EDGES} SELECT u % 211 AS way, CAST(sum(length_m) AS BIGINT) AS m, CASE WHEN u % 211 % 3 = 0 THEN 600 + u % 211 * 20 END AS seconds FROM edges GROUP BY u % 211")
    timed = F.least(F.lit(60), F.greatest(F.lit(5), F.floor(F.col("m") * 3.6 / F.col("seconds") + 0.5)))
    return rows.select("way", "m", F.coalesce(F.when(F.col("seconds").isNotNull(), timed), F.when(F.col("m") < 2000, 10).when(F.col("m") < 8000, 20).otherwise(30)).cast("long").alias("kmh"), F.lit(0).cast("long").alias("no_cost"))


FERRY_SQL = f"""WITH {EDGES}, w AS (SELECT u % 211 AS way, count(*) * 100 AS m FROM edges GROUP BY u % 211) SELECT way, m, CAST(CASE WHEN way % 3 = 0 THEN CASE WHEN m * 3.6 / (600 + way * 20) + 0.5 < 5 THEN 5 WHEN m * 3.6 / (600 + way * 20) > 60 THEN 60 ELSE floor(m * 3.6 / (600 + way * 20) + 0.5) END WHEN m < 2000 THEN 10 WHEN m < 8000 THEN 20 ELSE 30 END AS BIGINT) AS kmh, CAST(0 AS BIGINT) AS no_cost FROM w"""


PROGRAMS = {
    "encode_polylines": (polylines, POLYLINES),
    "decode_polylines": (round_trip(lambda p: C.decode_polyline(C.encode_polyline(p, 6), 6)), _POINTS),
    "decode_varints": (round_trip(lambda p: C.decode7(C.encode7(p, 6), 6)), _POINTS),
    "predicted_speeds": (week_speeds, WEEKS),
    "opening_hours": (hours, HOURS_SQL),
    "street_names": (street_names, STREETS_SQL),
    "common_names": (common_names, COMMON_SQL),
    "tagged_units": (tagged_units, UNITS_SQL),
    "spoken_phrases": (phrases, PHRASES_SQL),
    "level_lists": (level_lists, LEVELS_SQL),
    "gzip_and_base64": (gzip_and_base64, GZIP_SQL),
    "local_times": (local_times, TIMES_SQL),
    "flow_speeds": (flow_speeds, FLOW_SQL),
    "turn_durations": (osrm_turns, OSRM_SQL),
    "ferry_speeds": (ferry_speeds, FERRY_SQL),
}
QUERIES = {name: f for name, (f, _) in PROGRAMS.items()}
ORACLES = {name: sql for name, (_, sql) in PROGRAMS.items()}
