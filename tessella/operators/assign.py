"""Which areas nodes, ways and relations belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.areasets import AreaSets
from tessella.operators.rangejoin import point_in_rect


def node_areas(nodes: DataFrame, areas: DataFrame, overlap: int = 0) -> DataFrame:
    """node_id, area_idx: a row for each area that holds the node."""
    points = nodes.select(F.col("id").alias("node_id"), "map_lat", "map_lon")
    return point_in_rect(points, areas, overlap).select("node_id", "area_idx")


def way_refs(ways: DataFrame) -> DataFrame:
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))


def members(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select("rel_id", "pos", "m.type", "m.ref", "m.role")


def way_sets(known: AreaSets, refs: DataFrame, node_sets: DataFrame) -> DataFrame:
    """way_id, set_no from the sets of the nodes of a way; nodes that are missing count for nothing."""
    return known.united(refs.select("way_id", "node_id").join(node_sets, "node_id").select("way_id", "set_no"), "way_id")


def relation_sets(known: AreaSets, mem: DataFrame, node_sets: DataFrame, way_sets_: DataFrame) -> DataFrame:
    """rel_id, set_no from the sets of the node and way members; member relations are not followed."""
    of = lambda kind, sets_, key: mem.where(F.col("type") == kind).select("rel_id", F.col("ref").alias(key)).join(sets_, key).select("rel_id", "set_no")
    return known.united(of("node", node_sets, "node_id").unionByName(of("way", way_sets_, "way_id")), "rel_id")


def several(known: AreaSets, found: DataFrame) -> DataFrame:
    """The keys of elements that lie in more than one area."""
    return known.several(found)


def merged(known: AreaSets, geometric: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Nodes: what geometry says and what a complete element needs, together."""
    return known.united(geometric.select(key, "set_no").unionByName(override.select(key, "set_no")), key)


def preferred(plain: DataFrame, override: DataFrame, key: str, first: DataFrame | None = None) -> DataFrame:
    """Ways and relations: `first` if there, else the override, else the plain set."""
    over = lambda low, high: low.join(high.select(key), key, "left_anti").select(key, "set_no").unionByName(high.select(key, "set_no"))
    out = over(plain, override)
    return out if first is None else over(out, first)
