"""Every trace point is snapped, also where its own node is missing."""

from roadweave.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_point_has_three_edges(spark):
    points = spark.read.parquet(f"{SF}/events.parquet").count()
    rows = catalog.QUERIES["nearest_edge_ring"](spark, SF).collect()
    assert len(rows) == 3 * points and len({r.event_id for r in rows}) == points


def test_several_candidates(spark):
    rows = catalog.QUERIES["trace_candidates"](spark, SF).collect()
    assert len(rows) > 2 * len({r.event_id for r in rows}) and max(r.d2 for r in rows) <= 50**2 * 1000
