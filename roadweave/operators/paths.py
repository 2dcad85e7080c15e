"""What follows a search: predecessors, whole paths by pointer doubling, components and arrivals by timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators.search import cut


def predecessors(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, node, pred): of each label the smallest node whose own label and arc make it up."""
    before = labels.select("src", F.col("node").alias("u"), F.col("cost").alias("c0"), F.col("dist").alias("d0"))
    made = before.join(arcs.select("u", "v", "w"), "u").select("src", F.col("v").alias("node"), "u", (F.col("c0") + F.col("w")).alias("cost"), (F.col("d0") + 1).alias("dist"))
    return labels.join(made, ["src", "node", "cost", "dist"]).groupBy("src", "node").agg(F.min("u").alias("pred"))


def paths(labels: DataFrame, arcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (src, dst) -> (src, dst, node, cost, dist): every node of each path, its ends included.

    Predecessors are squared until they reach no further, so a path of n nodes takes log n joins, and each join then doubles the
    part of the paths that is known. Pairs without a path give no row.
    """
    jumps = [cut(predecessors(labels, arcs), "jump")]
    while True:
        last = jumps[-1]
        onward = last.select("src", F.col("node").alias("pred"), F.col("pred").alias("far"))
        further = cut(last.join(onward, ["src", "pred"]).select("src", "node", F.col("far").alias("pred")), "jump")
        if further.isEmpty():
            break
        jumps.append(further)
    known = wanted.join(labels.select("src", F.col("node").alias("dst")), ["src", "dst"]).select("src", "dst", F.col("dst").alias("node"))
    for jump in reversed(jumps):
        known = cut(known.unionByName(known.join(jump, ["src", "node"]).select("src", "dst", F.col("pred").alias("node"))), "paths")
    return known.join(labels, ["src", "node"]).select("src", "dst", "node", "cost", "dist")


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component): the least node connected with each, by labels that jump to their own label's label."""
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).withColumnRenamed("u", "node")
    labels = cut(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        best = labels.join(near, "node").select("node", "l", F.least("l", "m").alias("m"))
        jumped = best.join(labels.select(F.col("node").alias("m"), F.col("l").alias("far")), "m")
        after = cut(jumped.select("node", F.least("m", "far").alias("l"), (F.least("m", "far") != F.col("l")).alias("moved")), "labels")
        labels = after.select("node", "l")
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("l", "component")


def arrivals(starts: DataFrame, connections: DataFrame) -> DataFrame:
    """starts (src, stop, at), connections (a, dep, b, arr) -> (src, stop, at): the earliest time at every stop, by rounds of boardings.

    A round joins the stops that were reached earlier in the round before with the connections that leave them afterwards; it
    ends when nothing improves. Only improved labels move.
    """
    conn = cut(connections.select("a", "dep", "b", "arr"), "connections")
    labels = fresh = cut(starts.select("src", "stop", "at"), "arrivals")
    while True:
        ride = fresh.join(conn, (F.col("stop") == F.col("a")) & (F.col("dep") >= F.col("at"))).groupBy("src", F.col("b").alias("stop")).agg(F.min("arr").alias("new"))
        better = ride.join(labels, ["src", "stop"], "left").where(F.col("at").isNull() | (F.col("new") < F.col("at")))
        fresh = cut(better.select("src", "stop", F.col("new").alias("at")), "fresh")
        if fresh.isEmpty():
            return labels
        labels = cut(labels.unionByName(fresh).groupBy("src", "stop").agg(F.min("at").alias("at")), "arrivals")
