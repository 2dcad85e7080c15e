"""Small fixtures with known answers: files, codings, geometry, matching and tours."""

import gzip
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweave.functions import codecs, shapes
from roadweave.plans import matching, routes
from roadweave.sources import files



def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def pts(*xy):
    return F.array(*(shapes.point(float(x), float(y)) for x, y in xy))


def test_polyline_known_text(spark):
    """The published example of the five-digit coding."""
    line = pts((-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252))
    assert one(spark, codecs.encode_polyline(line, 5)) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    back = one(spark, codecs.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), 5))
    assert [(p.x, p.y) for p in back] == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert one(spark, codecs.decode_polyline(F.lit(""), 5)) == []


def test_varint_bytes(spark):
    assert bytes(one(spark, codecs.encode7(pts((0.000150, 0.0)), 6))) == bytes([0, 0xAC, 0x02])


def test_speeds_round_trip(spark):
    speeds = F.transform(F.sequence(F.lit(0), F.lit(2015)), lambda b: 50 + 20 * F.cos(b * 2 * math.pi / 2016))
    text = codecs.encode_speeds(codecs.compress_speeds(speeds))
    found = one(spark, codecs.speed_at(codecs.decode_speeds(text), F.lit(504)))
    assert abs(found - 50) < 1 and one(spark, codecs.decode_speeds(F.lit("AAAA"))) is None and one(spark, codecs.decode_speeds(F.lit("*"))) is None


def test_opening_hours(spark):
    rules = codecs.opening_hours(F.lit("Mo-Fr 07:00-09:00; Sa,Su 22:00-02:30; PH off"))
    at = lambda day, minute: one(spark, codecs.open_at(rules, F.lit(day), F.lit(minute)))
    assert [at(1, 420), at(1, 540), at(6, 1330), at(0, 60), at(1, 60), at(2, 60)] == [True, False, True, True, True, False]


@pytest.mark.parametrize(("ref", "said"), [("I 405", "Interstate 4 oh 5"), ("US 20", "U.S. 20"), ("CR 7", "County Route 7"), ("I 476", "Interstate 4 76")])
def test_spoken_refs(spark, ref, said):
    assert one(spark, codecs.verbal_ref(F.lit(ref))) == said


def test_polygon(spark):
    square, hole = pts((0, 0), (4, 0), (4, 4), (0, 4)), pts((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    assert one(spark, shapes.area(square)) == one(spark, shapes.area(hole)) == 16
    for p, inside in (((1, 1), True), ((5, 1), False), ((-1, 3), False)):
        q = shapes.point(float(p[0]), float(p[1]))
        assert (one(spark, shapes.winding(q, square)) != 0) is inside and one(spark, shapes.even_odd(q, square)) is inside


def test_simplified_keeps_within_tolerance():
    rng = np.random.default_rng(4)
    xy = np.cumsum(rng.normal(size=(200, 2)), axis=0)
    kept = shapes.simplified(xy, 2.0)
    assert kept[0] == 0 and kept[-1] == 199 and len(kept) < 150
    for a, b in itertools.pairwise(kept):
        d = xy[b] - xy[a]
        t = np.clip((xy[a : b + 1] - xy[a]) @ d / (d @ d), 0, 1)
        assert (np.hypot(*(xy[a : b + 1] - xy[a] - t[:, None] * d).T) <= 2.0 + 1e-9).all()


def test_tour_is_the_best_permutation():
    rng = np.random.default_rng(8)
    gap = lambda a, b: abs(a // 50 - b // 50) + abs(a % 50 - b % 50)
    for n in range(1, 8):
        stops = rng.integers(0, 2000, n).tolist()
        every = [[stops[0], *p, *stops[1:][-1:]] for p in itertools.permutations(stops[1:-1])]
        assert matching.tour(stops)[1] == min(sum(map(gap, t, t[1:])) for t in every)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(6)
    for _ in range(30):
        rows = []
        for i in range(4):
            x, y = int(rng.integers(0, 12)), int(rng.integers(0, 12))
            for u in {int(y * 50 + x + rng.choice([0, 1, 50])) for _ in range(3)}:
                rows.append((i, x, y, u * 4, u, int(rng.integers(0, 5000))))
        pdf = pd.DataFrame(rows, columns=["i", "x", "y", "eid", "u", "emission"])
        found = matching.match(pdf)
        if any(fresh for *_, fresh in found[1:]):
            continue
        by = [list(own.itertuples(index=False)) for _, own in pdf.groupby("i")]

        def cost(path):
            total = path[0].emission
            for p, c in itertools.pairwise(path):
                route = 100 * (abs(p.u % 50 - c.u % 50) + abs(p.u // 50 - c.u // 50))
                if route > matching.BREAK:
                    return float("inf")
                total += c.emission + abs(route - 100 * max(abs(p.x - c.x), abs(p.y - c.y))) * 1000 // matching.BETA_MILLI
            return total

        assert found[-1][2] == min(cost(p) for p in itertools.product(*by))


def test_contour_rings_use_every_line(spark):
    sf = "/root/testdata/sf0.001"
    lines, rings = routes.contour_lines(spark, sf).where("x0 != x1 OR y0 != y1"), routes.contour_rings(spark, sf).collect()
    assert lines.count() == sum(len(r.pts) - 1 for r in rings)


def test_traffic_csv(spark, tmp_path):
    good = one(spark, codecs.encode_speeds(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i - 100).cast("int"))))
    (tmp_path / "a.csv").write_text(f"0/3/7,50,40,{good}\n0/3/7,1,1,\n1/2/3,60,,\nx/2/3,60,40,\n1/2/4,fast,40,\n1/2/5,60,40,AAAA\n")
    speeds, rejected = files.traffic_csv(spark, str(tmp_path))
    rows = {r.edge_id: r for r in speeds.collect()}
    assert rows.keys() == {"0/3/7", "1/2/3"} and rows["0/3/7"].free_flow == 50 and rows["0/3/7"].coefficients == list(range(-100, 100))
    assert rows["1/2/3"].constrained_flow is None and {r.edge_id for r in rejected.collect()} == {"x/2/3", "1/2/4", "1/2/5"}


def test_timetable(spark, tmp_path):
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id\nr,s,t\nr,s,f\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,24:10:00,24:10:00,b,2\nt,23:50:00,23:55:00,a,1\nf,00:00:00,00:00:00,a,1\nf,00:05:00,00:05:00,b,2\n")
    (tmp_path / "frequencies.txt").write_text("trip_id,start_time,end_time,headway_secs\nf,08:00:00,08:30:00,600\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,0,0,0,0,0,0,20240101,20240114\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\ns,20240108,2\ns,20240110,1\n")
    feed = files.gtfs(spark, str(tmp_path))
    rides = {(r.trip_id, r.a, r.dep, r.b, r.arr) for r in files.departures(feed).collect()}
    assert rides == {("t", "a", 86100, "b", 87000), ("f", "a", 28800, "b", 29100), ("f", "a", 29400, "b", 29700), ("f", "a", 30000, "b", 30300)}
    assert {str(r.day) for r in files.service_days(feed["calendar"], feed["calendar_dates"]).collect()} == {"2024-01-01", "2024-01-10"}
    assert feed["stops"].count() == 0


def test_elevation_tiles(spark, tmp_path):
    grid = (np.arange(9) * 100 - 200).astype(">i2")
    (tmp_path / "N52E005.hgt").write_bytes(grid.tobytes())
    (tmp_path / "S01W010.hgt.gz").write_bytes(gzip.compress(grid.tobytes()))
    rows = {(r.lat, r.lon, r.row, r.col): r.height for r in files.elevation_tiles(spark, str(tmp_path)).collect()}
    assert len(rows) == 18 and rows[52, 5, 1, 2] == 300 and rows[-1, -10, 0, 0] == -200


def test_requests(spark):
    lines = ['-j \'{"locations":[{"lat":52.1,"lon":5.2,"type":"break"}],"costing":"auto","contours":[{"time":10}]}\'', '{"encoded_polyline":"_p~iF~ps|U"}', "not json"]
    rows = files.requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.valid for r in rows] == [True, True, False] and rows[0].locations[0].lat == 52.1 and rows[0].contours[0].time == 10 and len(rows[1].shape) == 1


def test_bounding_circle_keeps_its_digits():
    """Shape 564000001 of sf0.1; in exact fractions its circle through points 2, 9 and 12 has a radius of 0.02386388500016491."""
    x = [17129, 30267, 47003, 15000, 18186, 36279, 26156, 9246, 24216, 1126, 20006, 31162, 7231, 45063, 1177, 28021]
    y = [33140, 14256, 26292, 5344, 11328, 11160, 4052, 9008, 4116, 15024, 36252, 4164, 1288, 5160, 15016, 33196]
    for at in ((5.0, 52.0), (-179.0, -80.0), (0.0, 0.0)):
        radius = shapes.bounding_circle(np.array([(at[0] + a / 1e6, at[1] + b / 1e6) for a, b in zip(x, y, strict=True)]))[2]
        assert abs(radius - 0.02386388500016491) < 1e-13


@pytest.mark.parametrize("step", [3e-6, 1e-6, 1e-8, 1e-12])
def test_place_between_points_that_almost_meet(spark, step):
    a, b = (5.0161, 52.0072), (5.0161 + step, 52.0072)
    found = one(spark, shapes.along(shapes.point(*a), shapes.point(*b), F.lit(0.3)))
    assert abs(found.x - (a[0] + 0.3 * (b[0] - a[0]))) < 2e-14 and abs(found.y - a[1]) < 2e-14


def test_place_between_far_points(spark):
    found = one(spark, shapes.along(shapes.point(0.0, 0.0), shapes.point(179.0, 0.0), F.lit(0.5)))
    assert abs(found.x - 89.5) < 1e-9 and abs(found.y) < 1e-9
