"""Live layers from a stream of events: speeds by window, sessions, and incidents that open and close."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadweave.operators.search import cut


def events(spark: SparkSession, path: str, glob: str = "events*.parquet") -> DataFrame:
    """A stream of the files of a folder, with a watermark of one hour on ``ts``."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def edge_speeds(stream: DataFrame) -> DataFrame:
    """Probes and summed speeds of each edge in windows of five minutes."""
    probe = stream.select("ts", (F.col("event_id") % 400).alias("edge"), (F.floor("value") % 120).alias("kmh"))
    found = probe.groupBy("edge", F.window("ts", "5 minutes")).agg(F.count("*").alias("probes"), F.sum("kmh").cast("long").alias("kmh"))
    return found.select("edge", F.unix_seconds(F.col("window.start")).alias("start"), "probes", "kmh")


def sessions(stream: DataFrame) -> DataFrame:
    """Runs of a user's events without a gap of half an hour."""
    found = stream.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("points"))
    return found.select("user_id", F.unix_seconds(F.col("session_window.start")).alias("start"), "points")


def incidents(stream: DataFrame) -> DataFrame:
    """(user_id, opened, closed): an ``error`` opens an incident if none is open, the next ``purchase`` closes it.

    The state of a user is one number. Events of a batch are taken in time order; a state untouched for a day of
    event time is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for kind, at in zip(rows["event_type"], rows["at"], strict=True):
            if kind == "error" and opened is None:
                opened = at
            elif kind == "purchase" and opened is not None:
                out.append((key[0], int(opened), int(at)))
                opened = None
        if opened is None:
            state.remove()
        else:
            state.update((int(opened),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["at"].max()) // 1000) + 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "opened", "closed"])

    named = stream.where(F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"))
    return named.groupBy("user_id").applyInPandasWithState(step, "user_id long, opened long, closed long", "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all input that is there now: batches are written as they come, and read when the last is done.

    In ``complete`` mode the last batch is the whole result, in ``append`` mode all batches together.
    """
    spark = stream.sparkSession
    folder = cut(spark.range(1), "stream").inputFiles()[0].rsplit("/", 1)[0] + f"-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def _query(function, mode: str):
    return lambda spark, sf_dir: drained(function(events(spark, sf_dir)), mode)


QUERIES = {
    "stream_edge_speeds": _query(edge_speeds, "complete"),  # STM1, STM4
    "stream_sessions": _query(sessions, "complete"),  # STM2
    "stream_incidents": _query(incidents, "append"),  # STM3
}
ORACLES = {
    "stream_edge_speeds": "SELECT event_id % 400 AS edge, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 300) AS BIGINT) * 300 AS start, count(*) AS probes, CAST(sum(CAST(floor(value) AS BIGINT) % 120) AS BIGINT) AS kmh FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS points FROM s GROUP BY user_id, k",
    "stream_incidents": "WITH r AS (SELECT user_id, event_type AS t, epoch_us(ts) AS u, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')), o AS (SELECT user_id, u, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM r WHERE t = 'error' AND coalesce(before, 'purchase') = 'purchase'), c AS (SELECT user_id, u, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM r WHERE t = 'purchase' AND before = 'error') SELECT o.user_id, o.u AS opened, c.u AS closed FROM o JOIN c ON c.user_id = o.user_id AND c.k = o.k",
}
