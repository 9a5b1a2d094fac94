"""Schemas of the map-data tables, written as DDL and built without a session."""

from pyspark.sql import types as T

_PLAIN = {"int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}


def _parts(text: str) -> list[str]:
    """Splits at commas outside angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(kind(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, kind(k)) for n, _, k in (p.partition(":") for p in _parts(text[7:-1]))])
    return _PLAIN[text]()


def table(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind(k)) for n, _, k in (p.partition(" ") for p in _parts(ddl))])


TAGS = "array<struct<k:string,v:string>>"
MEMBERS = "array<struct<type:string,ref:long,role:string>>"
NODES = table(f"id long, version int, lat double, lon double, map_lat int, map_lon int, tags {TAGS}")
WAYS = table(f"id long, version int, refs array<long>, tags {TAGS}")
RELATIONS = table(f"id long, version int, members {MEMBERS}, tags {TAGS}")
ELEMENT = table(f"kind string, id long, version int, lat double, lon double, refs array<long>, members {MEMBERS}, tags {TAGS}, box array<double>")
AREAS = table("area_idx int, map_id int, name string, min_lat int, min_lon int, max_lat int, max_lon int, is_pseudo boolean, joinable boolean")
DENSITY = table("x int, y int, n long")
CITIES = table("id int, country string, name string, lat int, lon int, population int")
PROBLEMS = table("kind string, id long")
EDGES = ("min_lat", "min_lon", "max_lat", "max_lon")
