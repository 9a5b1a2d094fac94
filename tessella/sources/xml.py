"""The XML map format as tile text, and by Spark's own XML reader (a scan for each element kind) for paths that only Spark opens."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.units import valid_node
from tessella.schema import ELEMENT, table

_TAG = "tag array<struct<_k:string,_v:string>>"
_HEAD = "_id long, _version int, _action string"
_NODE = table(f"{_HEAD}, _lat double, _lon double, {_TAG}")
_WAY = table(f"{_HEAD}, nd array<struct<_ref:long>>, {_TAG}")
_RELATION = table(f"{_HEAD}, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}")
_BOUNDS = table("_minlat double, _minlon double, _maxlat double, _maxlon double")
_BOUND = table("_box string")


def scan(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("node", "way", "relation", "bounds")) -> DataFrame:
    """Element rows; kinds that are not asked for are not scanned. Deleted elements and incomplete nodes are left out."""

    def read(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    tags = F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), F.coalesce(t["_v"], F.lit("")).alias("v"))), F.array()).alias("tags")
    live = F.coalesce(F.col("_action") != "delete", F.lit(True)) & F.col("_id").isNotNull()
    version = F.coalesce("_version", F.lit(0)).alias("version")
    parts = []
    if "node" in kinds:
        parts.append(read("node", _NODE).where(live & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).select(F.lit("node").alias("kind"), F.col("_id").alias("id"), version, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags))
    if "way" in kinds:
        refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")).alias("refs")
        parts.append(read("way", _WAY).where(live).select(F.lit("way").alias("kind"), F.col("_id").alias("id"), version, refs, tags))
    if "relation" in kinds:
        known = F.filter(F.coalesce("member", F.array().cast(_RELATION["member"].dataType)), lambda m: m["_type"].isin("node", "way", "relation"))
        members = F.transform(known, lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))).alias("members")
        parts.append(read("relation", _RELATION).where(live).select(F.lit("relation").alias("kind"), F.col("_id").alias("id"), version, members, tags))
    if "bounds" in kinds:
        box = F.array("_minlat", "_minlon", "_maxlat", "_maxlon")
        parts.append(read("bounds", _BOUNDS).where(~F.exists(box, lambda v: v.isNull())).select(F.lit("bounds").alias("kind"), box.alias("box")))
        old = F.transform(F.split("_box", ","), lambda v: v.try_cast("double"))
        parts.append(read("bound", _BOUND).where((F.size(old) == 4) & ~F.exists(old, lambda v: v.isNull())).select(F.lit("bounds").alias("kind"), old.alias("box")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    empty = spark.createDataFrame([], ELEMENT)
    return empty.unionByName(out, allowMissingColumns=True).select(*ELEMENT.names)


def strict_nodes(elements: DataFrame) -> DataFrame:
    """Raises at run time where a node lies outside the globe."""
    bad = (F.col("kind") == "node") & ~valid_node(F.col("lat"), F.col("lon"))
    return elements.withColumn("lat", F.when(bad, F.raise_error(F.concat(F.lit("node outside the globe: "), F.col("id").cast("string"))).cast("double")).otherwise(F.col("lat")))


def _quoted(s: str) -> str:
    return quoteattr(s, {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;", "'": "&apos;"}).replace("&quot;", '"') if '"' not in s else '"' + s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("'", "&apos;").replace("\n", "&#10;").replace("\r", "&#13;").replace("\t", "&#9;") + '"'


CLOSING = b"</osm>\n"


def opening(box: tuple[float, float, float, float] | None, versions: bool) -> bytes:
    """The head of a file: version 0.5 if no element has one."""
    out = ["<?xml version='1.0' encoding='UTF-8'?>", f"<osm version='{'0.6' if versions else '0.5'}'>"]
    if box:
        out.append(f"<bounds minlat='{box[0]:.7f}' minlon='{box[1]:.7f}' maxlat='{box[2]:.7f}' maxlon='{box[3]:.7f}'/>")
    return "\n".join([*out, ""]).encode()


def elements(rows: Iterable[tuple]) -> bytes:
    """Nodes, ways and relations, in this order; coordinates with 7 digits."""
    order = {"node": 0, "way": 1, "relation": 2}
    out = []
    for kind, id_, version, lat, lon, refs, members, tags, _ in sorted((r for r in rows if r[0] in order), key=lambda r: order[r[0]]):
        head = f"<{kind} id='{id_}'" + (f" version='{version}'" if version else "") + (f" lat='{lat:.7f}' lon='{lon:.7f}'" if kind == "node" else "")
        inner = [f"<nd ref='{r}'/>" for r in refs or ()]
        inner += [f"<member type='{m[0]}' ref='{m[1]}' role={_quoted(m[2] or '')}/>" for m in members or () if m[0] and m[1]]
        inner += [f"<tag k={_quoted(k)} v={_quoted(v)}/>" for k, v in tags or ()]
        out.append(head + (">" + "".join(inner) + f"</{kind}>" if inner else "/>"))
    return "\n".join([*out, ""]).encode()


def encode(rows: Iterable[tuple], box: tuple[float, float, float, float] | None = None) -> bytes:
    """The text of a whole file."""
    rows = list(rows)
    return opening(box, any(r[2] for r in rows)) + elements(rows) + CLOSING
