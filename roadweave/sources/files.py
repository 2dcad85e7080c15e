"""Readers of the file formats around a road network, each as a DataFrame; a row that can't be read doesn't fail the job."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions import codecs

# fixed values: the columns of the timetable files that are read
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string",
    "routes": "route_id string, agency_id string, route_short_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def traffic_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(speeds, rejected) of files ``level/tile/id,free,constrained,coefficients``; of rows that repeat an edge the first of its file counts.

    speeds: edge_id, level, tile, id, free_flow, constrained_flow, coefficients (null where none are given). A row is rejected if
    its id isn't three numbers, a speed isn't a number, or its coefficients don't decode to exactly 200.
    """
    rows = spark.read.text(path).select(F.split("value", ",").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    part = lambda k: F.trim(F.get(F.col("f"), F.lit(k)))
    number = lambda k: F.when(F.coalesce(part(k), F.lit("")) == "", F.lit(None)).otherwise(part(k)).try_cast("int")
    ids = F.transform(F.split(part(0), "/"), lambda p: p.try_cast("long"))
    given = lambda k: F.coalesce(part(k), F.lit("")) != ""
    read = rows.select("file", "row", part(0).alias("edge_id"), ids.alias("ids"), number(1).alias("free_flow"), number(2).alias("constrained_flow"), F.when(given(3), codecs.decode_speeds(part(3))).alias("coefficients"), given(1).alias("g1"), given(2).alias("g2"), given(3).alias("g3"))
    bad = (F.size("ids") != 3) | F.exists("ids", lambda i: i.isNull()) | (F.col("g1") & F.col("free_flow").isNull()) | (F.col("g2") & F.col("constrained_flow").isNull()) | (F.col("g3") & F.col("coefficients").isNull())
    good = read.where(~bad).withColumn("rn", F.row_number().over(Window.partitionBy("edge_id").orderBy("file", "row"))).where("rn = 1")
    speeds = good.select("edge_id", F.col("ids")[0].alias("level"), F.col("ids")[1].alias("tile"), F.col("ids")[2].alias("id"), "free_flow", "constrained_flow", "coefficients")
    return speeds, read.where(bad).select("file", "edge_id")


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a timetable feed by name; files or columns that a feed doesn't have are empty."""
    found = {}
    for name, schema in GTFS.items():
        wanted = [c.strip().split() for c in schema.split(",")]
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
            found[name] = rows.select(*((F.trim(F.col(c)).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)).alias(c) for c, kind in wanted))
        else:
            found[name] = spark.createDataFrame([], schema)
    return found


def seconds(clock):
    """Seconds of a time of the service day, which may go beyond 24:00:00; null if it can't be read."""
    part = lambda k: F.regexp_extract(clock, r"^\s*(\d{1,3}):(\d\d):(\d\d)\s*$", k).try_cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day): every day on which a service runs; added days count, taken ones don't."""
    date = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd")).cast("date")
    week = F.array(*(F.col(d) for d in ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")))
    regular = calendar.where(date("start_date") <= date("end_date")).select("service_id", week.alias("week"), F.explode(F.sequence(date("start_date"), date("end_date"))).alias("day"))
    regular = regular.where(F.element_at("week", F.dayofweek("day")) == 1).select("service_id", "day")
    changed = exceptions.select("service_id", date("date").alias("day"), "exception_type")
    added, taken = (changed.where(F.col("exception_type") == k).select("service_id", "day") for k in (1, 2))
    return regular.unionByName(added).distinct().join(taken, ["service_id", "day"], "left_anti")


def departures(feed: dict[str, DataFrame]) -> DataFrame:
    """Rides from a stop to the next of the trip: (route_id, service_id, trip_id, a, dep, b, arr), repeated by headway where frequencies are given."""
    order = Window.partitionBy("trip_id").orderBy("stop_sequence")
    times = feed["stop_times"].select("trip_id", F.col("stop_id").alias("a"), seconds(F.col("departure_time")).alias("dep"), F.lead("stop_id").over(order).alias("b"), seconds(F.lead("arrival_time").over(order)).alias("arr"), F.first(seconds(F.col("departure_time"))).over(order).alias("first"))
    rides = times.where("b IS NOT NULL").join(feed["trips"].select("trip_id", "route_id", "service_id"), "trip_id")
    runs = feed["frequencies"].select("trip_id", F.explode(F.sequence(seconds(F.col("start_time")), seconds(F.col("end_time")) - 1, F.col("headway_secs").cast("long"))).alias("start"))
    moved = F.coalesce(F.col("start") - F.col("first"), F.lit(0))
    return rides.join(runs, "trip_id", "left").select("route_id", "service_id", "trip_id", "a", (F.col("dep") + moved).alias("dep"), "b", (F.col("arr") + moved).alias("arr"))


def elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, row, col, height) of square ``.hgt`` files, plain or gzipped: big-endian 16-bit heights from the north-west corner."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grid = np.frombuffer(gzip.decompress(data) if name.endswith(".gz") else data, ">i2")
                side = int(len(grid) ** 0.5)
                tile = name.rsplit("/", 1)[-1]
                lat, lon = int(tile[1:3]) * (-1 if tile[0] == "S" else 1), int(tile[4:7]) * (-1 if tile[3] == "W" else 1)
                for r in range(0, side, 64):
                    part = grid[r * side : min(side, r + 64) * side].astype(np.int16)
                    at = np.arange(len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v, np.int32)) for v in (lat, lon)] + [pa.array((r + at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(part)], ["lat", "lon", "row", "col", "height"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "lat int, lon int, row int, col int, height short")


LOCATION = "struct<lat:double,lon:double,type:string,heading:int,radius:int,time:double>"
REQUEST = f"locations array<{LOCATION}>, sources array<{LOCATION}>, targets array<{LOCATION}>, costing string, contours array<struct<time:double,distance:double,color:string>>, shape array<{LOCATION}>, encoded_polyline string, date_time struct<type:int,value:string>"


def requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests of a text column, bare JSON or ``-j '<json>'``: the request's fields, its shape decoded, and ``valid``."""
    text = F.regexp_replace(F.trim(F.col(column)), r"^-j\s*'(.*)'$", "$1")
    given = F.transform(F.col("r.shape"), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    shape = F.when(F.col("r.encoded_polyline").isNotNull(), codecs.decode_polyline(F.col("r.encoded_polyline"))).otherwise(given)
    found = lines.select(F.from_json(text, REQUEST, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json(text).isNotNull().alias("valid"))
    return found.select("r.*", "valid", shape.alias("decoded")).drop("shape").withColumnRenamed("decoded", "shape")
