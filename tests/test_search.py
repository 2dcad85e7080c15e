"""The search without a hop bound against plain Dijkstra."""

import heapq

from roadweave.operators import search
from roadweave.operators.search import converge


def dijkstra(start, edges):
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    best, heap = {}, [(0, 0, start)]
    while heap:
        cost, dist, node = heapq.heappop(heap)
        if node not in best:
            best[node] = (cost, dist)
            for v, w in out.get(node, ()):
                heapq.heappush(heap, (cost + w, dist + 1, v))
    return best


def test_converge_is_dijkstra(spark):
    """A grid of 30 x 6, one way to the right on some rows, a dear short cut over many tiles, and an island."""
    edges = []
    for n in range(180):
        r, c = divmod(n, 30)
        near = ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c))
        edges += [(n, y * 30 + x, 1 + (n * 7 + i * 13) % 23) for i, (y, x) in enumerate(near) if 0 <= y < 6 and 0 <= x < 30 and not (r % 2 and i == 1)]
    edges += [(0, 179, 5000), (179, 0, 3), (500, 501, 1)]
    frame = spark.createDataFrame(edges, "u long, v long, w long")
    starts = [0, 17, 95, 179, 500]
    seeds = spark.createDataFrame([(s, s) for s in starts], "src long, node long")
    want = {(s, node, *label) for s in starts for node, label in dijkstra(s, edges).items()}
    assert {tuple(r) for r in converge(seeds, frame, tile=25, block=2).collect()} == want


def strip(rows: int) -> list[tuple[int, int, int]]:
    """A lattice five wide, whose best ways cross the borders of tiles back and forth."""
    near = lambda n: [m for m in (n + 1 if n % 5 < 4 else -1, n - 1 if n % 5 else -1, n + 5, n - 5) if 0 <= m < rows * 5]
    return [(n, m, 1 + (n * 37 + m * 101) % 29) for n in range(rows * 5) for m in near(n)]


def test_limit_leaves_the_labels_below_it(spark):
    edges = strip(30)
    frame, seeds = spark.createDataFrame(edges, "u long, v long, w long"), spark.createDataFrame([(s, s) for s in (0, 77)], "src long, node long")
    want = {(s, node, *label) for s in (0, 77) for node, label in dijkstra(s, edges).items() if label[0] <= 60}
    assert {tuple(r) for r in converge(seeds, frame, tile=40, limit=60).collect()} == want


def test_widening_goes_on_until_the_whole_search(spark):
    asked = []
    found = search.widening(lambda limit: asked.append(limit) or limit, lambda labels, limit: False, (1, 5))
    assert found is None and asked == [1, 5, None]
    assert search.widening(lambda limit: limit, lambda labels, limit: limit == 5, (1, 5)) == 5


def test_a_round_writes_only_what_it_settles(spark, monkeypatch):
    """Far tiles are no business of the first rounds: all rounds together write less than rounds times labels."""
    written, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df, name: written.append((name, found := cut(df, name))) or found)
    edges = strip(40)
    rows = converge(spark.createDataFrame([(0, 0)], "src long, node long"), spark.createDataFrame(edges, "u long, v long, w long"), tile=50).collect()
    rounds = [df.where("NOT hot").count() for name, df in written if name == "labels"][1:]
    assert {tuple(r) for r in rows} == {(0, node, *label) for node, label in dijkstra(0, edges).items()}
    assert len(rounds) >= 4 and rounds[0] <= 50 and max(rounds) <= 100
