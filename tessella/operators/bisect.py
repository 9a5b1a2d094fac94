"""Bisection of the density table, all tiles of a level at once; cells and lines stay in Spark.

Every cell carries its tile. A level is one aggregate by tile (nodes, and their means along both axes) and a join that gives
the cells of tiles that are cut their new tile; cells of tiles that are done leave. As many levels as the densest part needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.bounded import cut, hinted

TILE = ["x0", "y0", "w", "h"]


def _line(mean: Column, size: Column) -> Column:
    """The even line nearest below the mean in the middle three fifths; null where none lies inside."""
    fifth = F.floor(size / 5)
    at = F.least(F.greatest(mean, fifth), size - fifth).cast("int")
    at = at - at % 2
    return F.when((size >= 4) & (at > 0) & (at < size), at)


def bisect(cells: DataFrame, width: int, height: int, most: int) -> DataFrame:
    """x0, y0, w, h, n: tiles with at most `most` nodes, or without a line to cut at; cells: x, y, n. Empty tiles are left out.

    The longer side is cut first, the other one where the first has no line.
    """
    now = cut(cells.select("x", "y", "n", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(width).alias("w"), F.lit(height).alias("h")))
    done = []
    while True:
        mean = lambda v, low: F.expr(f"sum(n * ({v} - {low})) div sum(n)").alias(f"mean_{v}")
        tiles = now.groupBy(*TILE).agg(F.sum("n").alias("n"), mean("x", "x0"), mean("y", "y0"))
        across, up = _line(F.col("mean_x"), F.col("w")), _line(F.col("mean_y"), F.col("h"))
        tall = F.col("w") <= F.col("h")
        at = F.when(tall, F.coalesce(up, across)).otherwise(F.coalesce(across, up))
        by_y = F.when(tall, up.isNotNull()).otherwise(across.isNull())
        tiles = cut(tiles.select(*TILE, "n", F.when(F.col("n") > most, at).alias("at"), by_y.alias("by_y")))
        done.append(tiles.where("at is null").select(*TILE, "n"))
        open_ = tiles.where("at is not null").select(*TILE, "at", "by_y")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
        upper = F.when(F.col("by_y"), F.col("y") - F.col("y0") >= F.col("at")).otherwise(F.col("x") - F.col("x0") >= F.col("at"))
        moved = lambda start, size, ours: [F.when(ours & upper, F.col(start) + F.col("at")).otherwise(F.col(start)).alias(start), F.when(~ours, F.col(size)).when(upper, F.col(size) - F.col("at")).otherwise(F.col("at")).alias(size)]
        (x0, w), (y0, h) = moved("x0", "w", ~F.col("by_y")), moved("y0", "h", F.col("by_y"))
        now = cut(now.join(hinted(open_), TILE).select("x", "y", "n", x0, y0, w, h))
