"""Bisection level by level against the recursive one."""

import random

from tessella.operators import solver as S
from tessella.operators.bisect import bisect


def test_levels(spark):
    r = random.Random(11)
    for width, height, most in ((60, 44, 150), (9, 70, 60)):
        cells = {(min(width - 1, int(r.expovariate(6 / width))), r.randrange(height)): r.randint(1, 40) for _ in range(500)}
        m = S.DensityMap([(x, y, n) for (x, y), n in cells.items()], (0, 0, height << 11, width << 11), 11)
        df = spark.createDataFrame([(x, y, n) for (x, y), n in cells.items()], "x int, y int, n long")
        got = sorted((t.x0, t.y0, t.w, t.h, t.n) for t in bisect(df, width, height, most).collect())
        assert got == [(*t, m.count(t)) for t in S.bisect_tiles(m, most)] and len(got) > 8
    assert bisect(df.limit(0), 5, 5, 1).count() == 0
