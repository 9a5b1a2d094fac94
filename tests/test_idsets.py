"""Id sets against Python's."""

import random

from tessella.operators import idsets as I


def test_id_sets(spark):
    r = random.Random(3)
    a = {0, 1, -1, 32_768, 32_769, -32_768, -32_769, 10**12, -(10**12), *(r.randrange(-100_000, 100_000) for _ in range(500))}
    b = {r.randrange(-40_000, 40_000) for _ in range(300)}
    df = lambda s: spark.createDataFrame([(v,) for v in [*s, *s, None]], "id long")
    sa, sb = I.id_set(df(a), "id"), I.id_set(df(b), "id")
    assert {x.id for x in I.members(sa, "id").collect()} == a and I.members(sa, "id").count() == len(a) == I.size(sa)
    both = I.either(sa, sb)
    assert I.size(both) == len(a | b)
    tested = [*range(-33_000, 33_000, 7), *a, *b, 10**12 + 1]
    got = I.within(spark.createDataFrame([(v, str(v)) for v in tested], "id long, bits string"), "id", both)
    assert got.columns == ["id", "bits"] and sorted(x.id for x in got.collect()) == sorted(v for v in tested if v in a | b)
    assert I.within(df(a), "id", I.id_set(df(set()), "id")).count() == 0
