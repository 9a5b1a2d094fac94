"""Golden values of rounding and predicates at their borders."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import tags as G
from tessella.functions import units as U


def wrap(v):
    return v - (1 << 32) if v >= 1 << 31 else v


@pytest.mark.parametrize(("v", "want"), [(0x1D5842, 0x1D5800), (0x2399A, 0x23800), (0xFFCBBA86, 0xFFCBB800)])
def test_down(v, want):
    assert U.down(wrap(v), 11) == wrap(want)


@pytest.mark.parametrize(("v", "want"), [(0x1E7FAA, 0x1E8000), (0xFFCBBA86, 0xFFCBC000)])
def test_up(v, want):
    assert U.up(wrap(v), 11) == wrap(want)


@pytest.mark.parametrize(("v", "want"), [(7, 8), (6, 8), (5, 4), (4, 4), (3, 4), (2, 4), (1, 0), (-1, 0), (-2, 0), (-3, -4), (-5, -4)])
def test_near(v, want):
    assert U.near(v, 2) == want


@given(st.integers(-(1 << 23), 1 << 23), st.integers(0, 16))
def test_rounding_holds(v, s):
    assert U.down(v, s) <= v <= U.up(v, s) and U.up(v, s) - U.down(v, s) in (0, 1 << s)


def test_columns_agree_with_numbers(spark):
    vals = [*range(-50, 50), *range(0, 50_000, 1900), wrap(0xFFCBBA86), 0x1E7FAA]
    df = spark.createDataFrame([(v,) for v in vals], "v int")
    for s in (0, 2, 11):
        got = df.select("v", U.round_down(F.col("v"), s), U.round_up(F.col("v"), s), U.round_near(F.col("v"), s)).collect()
        assert all(tuple(r) == (r.v, U.down(r.v, s), U.up(r.v, s), U.near(r.v, s)) for r in got)
    d = spark.createDataFrame([(x / 7,) for x in range(-1260, 1261)], "d double").select("d", U.to_map_unit(F.col("d")).alias("u")).collect()
    assert all(r.u == U.map_unit(r.d) for r in d)


def test_predicates(spark):
    rows = [(y, x) for y in range(-2, 13) for x in (-2, -1, 0, 5, 10, 11, 12)]
    box = {"min_lat": F.lit(0), "min_lon": F.lit(0), "max_lat": F.lit(10), "max_lon": F.lit(10)}
    got = spark.createDataFrame(rows, "y int, x int").select("y", "x", U.contains_point(box, F.col("y"), F.col("x")).alias("c"), U.segment_hits(box, F.col("y"), F.col("x"), F.col("y"), F.col("x")).alias("s")).collect()
    for r in got:
        assert r.c == (0 <= r.y <= 10 and 0 <= r.x <= 10)
        assert r.s == (-1 <= r.y <= 11 and -1 <= r.x <= 11)


def test_tags(spark):
    t = "array<struct<k:string,v:string>>"
    rows = [([("type", "multipolygon")],), ([("type", "boundary"), ("boundary", "administrative"), ("admin_level", "4")],), ([("type", "boundary"), ("boundary", "administrative"), ("admin_level", "6")],), ([("type", "restriction:bus")],), ([("type", "route"), ("route", "bus")],), ([("a", "b"), ("old_name", "x"), ("my_name", "y")],), ([],)]
    df = spark.createDataFrame(rows, f"tags {t}")
    assert [r[0] for r in df.select(G.wanted_relation(F.col("tags"))).collect()] == [True, False, True, True, False, False, False]
    assert df.select(G.wanted_relation(F.col("tags"), routes=["bus"])).collect()[4][0] and not df.select(G.wanted_relation(F.col("tags"), routes=["road"])).collect()[4][0]
    assert df.select(G.wanted_relation(F.col("tags"), routes=["road"], any_route=True)).collect()[4][0]
    assert [r[0] for r in df.select(G.display_name(F.col("tags"))).collect()][-2:] == ["y", "?"]
    ring = spark.createDataFrame([([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)],), ([(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)],)], "r array<struct<lat:int,lon:int>>")
    assert {r[0] for r in ring.select(U.clockwise(F.col("r"))).collect()} == {True, False}
