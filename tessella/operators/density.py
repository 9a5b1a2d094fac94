"""The node histogram from which tiles are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import units as U

WORLD = (-U.MAX_LAT, -U.MAX_LON, U.MAX_LAT, U.MAX_LON)


def world(shift: int) -> tuple[int, int, int, int]:
    lat = U.map_unit(U.LAT_LIMIT)
    return (U.down(-lat, shift), -U.MAX_LON, U.up(lat, shift), U.MAX_LON)


def density(nodes: DataFrame, shift: int = 11, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """x, y, n: nodes by grid cell of 2^shift units from the lower left of bounds; those outside are left out, and
    those on the upper edges count in the last cell."""
    a, b, c, d = bounds or world(shift)
    inside = F.col("map_lat").between(a, c) & F.col("map_lon").between(b, d)
    x = F.least(F.shiftright(F.col("map_lon") - b, shift), F.lit((d - b >> shift) - 1))
    y = F.least(F.shiftright(F.col("map_lat") - a, shift), F.lit((c - a >> shift) - 1))
    return nodes.where(inside).select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))


def bbox(nodes: DataFrame) -> DataFrame:
    """One row: the exact box of the nodes; a box without extent is widened by one unit."""
    e = nodes.agg(F.min("map_lat").alias("min_lat"), F.min("map_lon").alias("min_lon"), F.max("map_lat").alias("top"), F.max("map_lon").alias("right"))
    return e.select("min_lat", "min_lon", U.widen(F.col("min_lat"), F.col("top")).alias("max_lat"), U.widen(F.col("min_lon"), F.col("right")).alias("max_lon"))


def union_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.agg(F.min("min_lat").alias("min_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"), F.max("max_lon").alias("max_lon"))


def subset(cells: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The cells of a part, moved to its own lower left."""
    ok = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return cells.where(ok).select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "n")


def line_sums(cells: DataFrame, axis: str) -> DataFrame:
    """Sum of each column (axis x) or row (axis y)."""
    return cells.groupBy(axis).agg(F.sum("n").alias("n"))


def merge_sea(land: DataFrame, sea: DataFrame, factor: int = 2) -> DataFrame:
    """Cells without nodes of their own get factor times the sea's count."""
    both = land.select("x", "y", F.col("n").alias("base")).join(sea.select("x", "y", F.col("n").alias("sea")), ["x", "y"], "full")
    n = F.when(F.coalesce("base", F.lit(0)) == 0, factor * F.coalesce("sea", F.lit(0))).otherwise(F.col("base"))
    return both.select("x", "y", n.cast("long").alias("n")).where("n > 0")


def running(sums: DataFrame, axis: str) -> DataFrame:
    """Sums of an axis with the running sum and the total. One row for each line of the grid: a bounded table."""
    order = W.orderBy(axis)
    upto, total = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return sums.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(total))


def valid_split_range(sums: DataFrame, axis: str, least: int) -> DataFrame:
    """first, last: split positions (lines below the cut) that leave at least `least` nodes on both sides; null if none."""
    ok = running(sums, axis).where((F.col("upto") >= least) & (F.col("total") - F.col("upto") >= least))
    return ok.agg((F.min(axis) + 1).alias("first"), (F.max(axis) + 1).alias("last"))


def median_split(sums: DataFrame, axis: str) -> DataFrame:
    """split, below, above: the cut whose lower half is nearest to half of the nodes; the lower one of equals."""
    both = running(sums, axis).withColumn("off", F.abs(2 * F.col("upto") - F.col("total")))
    best = both.agg(F.min(F.struct("off", axis, "upto", "total")).alias("b"))
    return best.select((F.col("b")[axis] + 1).alias("split"), F.col("b.upto").alias("below"), (F.col("b.total") - F.col("b.upto")).alias("above"))


def first_above(sums: DataFrame, axis: str, limit: int) -> DataFrame:
    """position: the first line at which the running sum exceeds the limit."""
    return running(sums, axis).where(F.col("upto") > limit).agg(F.min(axis).alias("position"))


def empty_runs(sums: DataFrame, axis: str) -> DataFrame:
    """start, length of every run of lines without nodes between lines with nodes."""
    nxt = F.lead(axis).over(W.orderBy(axis))
    gaps = sums.where("n > 0").select(F.col(axis).alias("at"), nxt.alias("nxt")).where("nxt > at + 1")
    return gaps.select((F.col("at") + 1).alias("start"), (F.col("nxt") - F.col("at") - 1).alias("length"))


def min_parts(count: Column, most: int) -> Column:
    return F.floor((count + most - 1) / most).cast("long")
