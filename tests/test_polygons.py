"""Points in polygons against the plain even-odd rule."""

import random

from tessella.operators import polygons as Y


def plain(y, x, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (b <= x) != (d <= x):
            v = (x - b) * (c - a) - (y - a) * (d - b)
            odd ^= (v if d > b else -v) >= 0
    return odd


def test_inside(spark):
    r = random.Random(2)
    rings = [(k, [(r.randint(-40, 40) * s, r.randint(-40, 40) * s) for _ in range(r.randint(3, 9))]) for k in range(12) for s in (1, 50_000)]
    square = [(0, 0), (0, 20), (20, 20), (20, 0), (0, 0)]  # closed
    rings += [(50, square), (50, [(5, 5), (15, 5), (15, 15), (5, 15)]), (51, [(1, 1), (2, 2)]), (52, [])]
    at = [(r.randint(-42, 42) * s, r.randint(-42, 42) * s) for s in (1, 50_000) for _ in range(400)] + [(0, 0), (20, 20), (5, 5), (10, 10)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, map_lat int, map_lon int")
    df = spark.createDataFrame(rings, "poly_id int, ring array<struct<lat:int,lon:int>>")
    got = {(x.id, x.poly_id) for x in Y.inside(points, df, ["id"]).collect()}
    want = {(i, k) for i, (y, x) in enumerate(at) for k in {k for k, _ in rings} if sum(plain(y, x, g) for j, g in rings if j == k and len(g) > 2) % 2}
    assert got == want
    assert Y.inside(points, df.limit(0), ["id"]).count() == 0


def test_totals(spark):
    """Whole cells and touched ones, with sides along meridians and cell borders, steep edges, holes, self-crossings and repeated places."""
    r = random.Random(3)
    rings = [(k, [(r.randint(-40, 40) * s, r.randint(-40, 40) * s) for _ in range(r.randint(3, 9))]) for k in range(12) for s in (1, 3)]
    rings += [(50, [(0, 0), (0, 64), (64, 64), (64, 0), (0, 0)]), (50, [(8, 8), (40, 8), (40, 33), (8, 33)]), (51, [(1, 1), (2, 2)]), (52, []), (53, [(-100, 3), (100, 5), (100, 6), (-100, 4)]), (54, [(-90, 16), (90, 16), (90, -16), (-90, -16)])]
    at = [(r.randint(-100, 100), r.randint(-100, 100)) for _ in range(1500)] * 2
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "v long, map_lat int, map_lon int")
    df = spark.createDataFrame(rings, "poly_id int, ring array<struct<lat:int,lon:int>>")
    want = {}
    for i, (y, x) in enumerate(at):
        for k in {k for k, _ in rings}:
            if sum(plain(y, x, g) for j, g in rings if j == k and len(g) > 2) % 2:
                n, v = want.get(k, (0, 0))
                want[k] = (n + 1, v + i)
    for shift in (2, 4, 13):
        assert {t.poly_id: (t.n, t.v) for t in Y.totals(points, df, ["v"], shift).collect()} == want
    assert Y.totals(points, df.limit(0), ["v"]).count() == 0 and Y.totals(points.limit(0), df, ["v"]).count() == 0
