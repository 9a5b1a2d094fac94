"""Functions on tag lists: arrays of struct k, v in file order, where the first of a key counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation types that are always used, names in order of search.
USED_TYPES = ["restriction", "through_route", "associatedStreet", "street"]
NAME_KEYS = ["name", "name:en", "int_name", "note"]
NOT_BY_DEFAULT = ["administrative", "postal_code", "political"]


def get_tag(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def without_author(tags: Column) -> Column:
    return F.filter(tags, lambda t: t["k"] != "created_by")


def admin_levels(lowest: int) -> list[str]:
    return [str(i) for i in range(max(2, lowest), 12)]


def wanted_relation(tags: Column, lowest_admin_level: int = 5, boundaries: list[str] | None = None, routes: list[str] | None = None, any_route: bool = False) -> Column:
    """Whether a relation is kept complete by its tags.

    boundaries None: all but administrative, postal and political ones; else those listed. routes: route values kept;
    any_route keeps every route once a list is given, as older versions did.
    """
    kind, boundary, level, route = (get_tag(tags, k) for k in ("type", "boundary", "admin_level", "route"))
    if boundaries is None:
        kept = ~boundary.isin(NOT_BY_DEFAULT)
    else:
        kept = boundary.isin(boundaries) if boundaries else F.lit(False)
    levels = level.isin(admin_levels(lowest_admin_level))
    area = kind.isin("multipolygon", "boundary") & (boundary.isNull() | F.coalesce(kept, F.lit(False)) | F.coalesce(levels, F.lit(False)))
    always = kind.isin(USED_TYPES) | kind.startswith("restriction:")
    way = (kind == "route") & (F.lit(any_route) | route.isin(routes)) if routes else F.lit(False)
    return F.coalesce(always | area | way, F.lit(False))


def display_name(tags: Column) -> Column:
    """The first name tag in file order, else the last whose key holds "name", else the postal code, else ?."""
    first = F.get(F.filter(tags, lambda t: t["k"].isin(NAME_KEYS)), F.lit(0))["v"]
    named = F.filter(tags, lambda t: t["k"].contains("name"))
    last = F.when(F.size(named) > 0, F.element_at(named, -1)["v"])
    return F.coalesce(first, last, F.concat(F.lit("postal_code="), get_tag(tags, "postal_code")), F.lit("?"))


def closed_way(refs: Column) -> Column:
    return (F.size(refs) > 1) & (F.element_at(refs, 1) == F.element_at(refs, -1))


def element_version(version: Column, mode: str = "remove") -> Column:
    """remove: 0, fake: 1, keep: as read."""
    return {"remove": F.lit(0), "fake": F.lit(1), "keep": F.coalesce(version, F.lit(0))}[mode]


def padded_id(map_id: Column) -> Column:
    return F.lpad(map_id.cast("string"), 8, "0")
