"""Rows that all map readers make: kind, id, version, lat, lon, refs, members, tags; bounds are rows of kind bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tags import without_author
from tessella.functions.units import rect, to_map_unit, verify
from tessella.schema import ELEMENT

__all__ = ["ELEMENT", "bounds", "counters", "nodes", "observed", "relations", "row", "told", "ways"]


def row(kind: str, id_: int | None = None, version: int = 0, lat=None, lon=None, refs=None, members=None, tags=None, box=None) -> tuple:
    return kind, id_, version, lat, lon, refs, members, tags or [], box


def nodes(elements: DataFrame) -> DataFrame:
    e = elements.where("kind = 'node'")
    return e.select("id", "version", "lat", "lon", to_map_unit(F.col("lat")).alias("map_lat"), to_map_unit(F.col("lon")).alias("map_lon"), without_author(F.col("tags")).alias("tags"))


def ways(elements: DataFrame) -> DataFrame:
    return elements.where("kind = 'way'").select("id", "version", "refs", without_author(F.col("tags")).alias("tags"))


def relations(elements: DataFrame) -> DataFrame:
    return elements.where("kind = 'relation'").select("id", "version", "members", without_author(F.col("tags")).alias("tags"))


def counters(elements: DataFrame) -> DataFrame:
    """kind, n and last (the largest id) of what was read: one partial aggregate."""
    return elements.where("kind <> 'bounds'").groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last"))


KINDS = ("node", "way", "relation")


def observed(elements: DataFrame) -> tuple[DataFrame, Observation]:
    """elements as they are, and counters that fill while another job reads them all; a job that is run twice counts once."""
    seen = Observation()
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return elements.observe(seen, *[f(of(k)).alias(f"{k}_{n}") for k in KINDS for n, f in (("n", F.count), ("last", F.max))]), seen


def told(spark: SparkSession, seen: Observation) -> DataFrame:
    """kind, n and last of an observation whose job has ended, as counters gives them."""
    got = seen.get
    return spark.createDataFrame([(k, got[f"{k}_n"], got[f"{k}_last"]) for k in KINDS if got[f"{k}_n"]], "kind string, n long, last long")


def bounds(elements: DataFrame) -> DataFrame:
    """Edges of the bounds that files tell; raises at run time where edges are out of order or off the globe."""
    b = F.col("box")
    edges = elements.where("kind = 'bounds'").select(*[to_map_unit(b[i]).alias(k) for i, k in enumerate(("min_lat", "min_lon", "max_lat", "max_lon"))])
    wrong = F.raise_error(F.concat(F.lit("invalid bounds: "), F.concat_ws(",", *edges.columns))).cast("int")
    return edges.withColumn("min_lat", F.when(verify(rect()), F.col("min_lat")).otherwise(wrong))
