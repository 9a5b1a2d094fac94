"""Joins with rectangles of unequal size against plain versions, and the bounds of their cells."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import problems as P
from tessella.operators import rangejoin as R
from tessella.operators.bounded import hinted

WORLD = (-(1 << 22), -(1 << 23), 1 << 22, 1 << 23)
RECT = "area_idx int, min_lat int, min_lon int, max_lat int, max_lon int"


def tiles(kind):
    """Disjoint rectangles with what is left of the world between them, or any rectangles."""
    r = random.Random(4)
    if kind == "small":  # a thousand tiles of 4096 units and the pseudo areas around them
        own = [(y << 12, x << 12, (y + 1) << 12, (x + 1) << 12) for y in range(25) for x in range(40)]
        return own + P.cover(own, WORLD)
    if kind == "halved":  # sides from 2**11 to 2**22
        out, left = [], [WORLD]
        while left:
            a, b, c, d = left.pop()
            if max(c - a, d - b) <= 2048 or (r.random() < 0.2 and c - a <= 1 << 21):
                out.append((a, b, c, d))
            elif c - a > d - b:
                left += [((a + c) // 2, b, c, d)] + [(a, b, (a + c) // 2, d)] * (r.random() < 0.6)
            else:
                left += [(a, (b + d) // 2, c, d)] + [(a, b, c, (b + d) // 2)] * (r.random() < 0.6)
            if len(left) + len(out) > 700:
                return out + left
        return out
    return [(y, x, y + r.choice([0, 1, 2047, 1 << 20]), x + r.choice([0, 3, 5000, 1 << 23])) for y, x in ((r.randrange(-(1 << 22), 1 << 21), r.randrange(-(1 << 23), 1 << 22)) for _ in range(120))]


@pytest.mark.parametrize("kind", ["small", "halved", "any"])
def test_mixed_sizes(spark, kind):
    r = random.Random(5)
    rects = tiles(kind)
    areas = spark.createDataFrame([(i, *a) for i, a in enumerate(rects)], RECT)
    at = [(r.choice((a[0], a[2], r.randint(a[0], a[2]))), r.choice((a[1], a[3], r.randint(a[1], a[3])))) for a in r.choices(rects, k=300)]
    points = spark.createDataFrame(at, "map_lat int, map_lon int")
    for grow in (0, 2000):
        got = sorted((p.map_lat, p.map_lon, p.area_idx) for p in R.point_in_rect(points, areas, grow).collect())
        assert got == sorted((y, x, i) for y, x in at for i, (a, b, c, d) in enumerate(rects) if a - grow <= y <= c + grow and b - grow <= x <= d + grow)
    boxes = [(i, y, x, y + r.choice([0, 1, 900, 70_000, 1 << 22]), x + r.choice([0, 1, 4096, 1 << 21])) for i, (y, x) in enumerate(at[:150])]
    df = spark.createDataFrame(boxes, "way_id int, box_min_lat int, box_min_lon int, box_max_lat int, box_max_lon int")
    got = sorted((p.way_id, p.area_idx) for p in R.meeting(df, areas).collect())
    assert got == sorted((k, i) for k, y, x, t, s in boxes for i, (a, b, c, d) in enumerate(rects) if y <= c and t >= a and x <= d and s >= b)


@pytest.mark.parametrize("kind", ["small", "halved"])
def test_cells_are_few_and_shared_by_few(spark, kind):
    rects = tiles(kind)
    areas = spark.createDataFrame([(i, *a) for i, a in enumerate(rects)], RECT)
    pairs, step = R.size_levels(areas)
    cells = R.area_cells(areas, step)
    assert len(pairs) <= R.MOST
    assert cells.groupBy("area_idx").count().agg(F.max("count")).first()[0] <= 4
    assert cells.groupBy("size_y", "size_x", "cell_y", "cell_x").count().agg(F.max("count")).first()[0] <= 36


def test_no_areas(spark):
    none = spark.createDataFrame([], RECT)
    assert R.point_in_rect(spark.createDataFrame([(1, 2)], "map_lat int, map_lon int"), none).count() == 0


def test_areas_stand_on_levels_of_boxes_only(spark, monkeypatch):
    monkeypatch.setattr(R, "LIMIT", 100)
    areas = spark.createDataFrame([(i, *a) for i, a in enumerate(tiles("small"))], RECT)
    boxes = spark.createDataFrame([(1, 5, 5, 6, 9000), (2, 3, 9, 9000, 12)], "way_id int, box_min_lat int, box_min_lon int, box_max_lat int, box_max_lon int")
    low = min(y for y, _ in R.size_levels(areas)[0])
    assert sorted(R.box_levels(boxes, areas, [(12, 12), (20, 22)])[0]) == [(12, 14), (14, 12)]
    assert low == 12 and R.meeting(boxes, areas).where("way_id = 1").count() == 3  # columns 0, 1 and 2 of one row


def test_exploded_rows_are_not_broadcast_beyond_the_limit(spark):
    wide = spark.range(10).selectExpr("id", "explode(sequence(1, 100)) AS v")
    joined = spark.range(1000).join(hinted(wide, 50), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
