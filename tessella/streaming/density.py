"""A running node histogram over a stream of nodes: an extension beside the batch density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.density import density


def density_stream(nodes: DataFrame, shift: int = 11) -> DataFrame:
    """x, y, n of all nodes so far (output mode complete or update); state is a row for each cell of a bounded grid."""
    return density(nodes, shift)


def windowed_density(nodes: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", shift: int = 11) -> DataFrame:
    """start, x, y, n by event-time window; rows later than the watermark are dropped, as the caller chooses by `late`."""
    cell = nodes.withWatermark(time, late).select(F.window(time, width).alias("w"), F.shiftright(F.col("map_lon") + 0x800000, shift).alias("x"), F.shiftright(F.col("map_lat") + 0x400000, shift).alias("y"))
    return cell.groupBy("w", "x", "y").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "x", "y", "n")
