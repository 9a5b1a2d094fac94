"""Reading map files of any format, and writing one file for each tile."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from typing import IO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import o5m, pbf, storage, xml
from tessella.sources.element import ELEMENT
from tessella.sources.xmlsplit import XmlSource

EXTENSIONS = {"pbf": "osm.pbf", "o5m": "o5m", "xml": "osm.gz", "simulate": None}


class MapError(RuntimeError):
    pass


def unpack(name: str, data: bytes) -> bytes:
    """Undoes gz, bz2 and zip; of a zip, the first entry whose name begins like the file's."""
    if name.endswith(".gz"):
        return gzip.decompress(data)
    if name.endswith(".bz2"):
        return bz2.decompress(data)
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            base = name.rpartition("/")[2].removesuffix(".zip")
            return z.read(next((n for n in z.namelist() if n.startswith(base)), z.namelist()[0]))
    return data


def read_elements(spark: SparkSession, paths: list[str], kinds: tuple[str, ...] = ("node", "way", "relation", "bounds")) -> DataFrame:
    """Element rows of all files: by suffix o5m, pbf, else XML (plain, gz or bz2; zip unpacked)."""
    out = spark.createDataFrame([], ELEMENT)
    for path in paths:
        if path.endswith((".pbf", ".o5m", ".zip")):
            rows = _binary(spark, path)
        elif storage.files(path):
            spark.dataSource.register(XmlSource)
            rows = spark.read.format("map_xml").option("kinds", ",".join(kinds)).load(path)
        else:  # what only Spark opens
            rows = xml.scan(spark, path, kinds)
        out = out.unionByName(rows.where(F.col("kind").isin(*kinds)))
    return out


def _binary(spark: SparkSession, path: str) -> DataFrame:
    """By blobs (pbf) or one after another (o5m) where executors can open the files themselves; else files that Spark opens as bytes.

    Rows are made as they are asked for: a task holds 10,000 at a time, and of an o5m file that it opens a block.
    """
    if path.endswith(".pbf") and storage.known(path):
        spark.dataSource.register(pbf.PbfSource)
        return spark.read.format("map_pbf").load(path)
    opened = path.endswith(".o5m") and storage.known(path)

    def of_bytes(name: str, data: bytes) -> Iterator[tuple]:
        raw = unpack(name, bytes(data))
        plain = name.removesuffix(".zip")
        return pbf.decode(raw) if plain.endswith(".pbf") else o5m.decode(raw) if plain.endswith(".o5m") else _plain_xml(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, name in enumerate(pdf["path"]):
                rows = iter(file_rows(name) if opened else of_bytes(name, pdf["content"][i]))
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=ELEMENT.names)

    if opened:
        return spark.createDataFrame([(path,)], "path string").mapInPandas(run, ELEMENT)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ELEMENT)


def file_rows(path: str) -> Iterator[tuple]:
    """Element rows of a tile file (pbf, o5m, or gzipped XML) that a task opens itself, one after another as the file is read.

    A pbf file is held by blob, XML by element, an o5m file by blocks.
    """
    if path.endswith(".pbf"):
        reader = pbf.PbfSource({"path": path}).reader(ELEMENT)
        for part in reader.partitions():
            yield from reader.read(part)
    elif path.endswith(".o5m"):
        with storage.open_input(path) as f:
            yield from o5m.decode(f)
    else:
        with storage.open_input(path) as f, gzip.open(f) as text:
            yield from _plain_xml(text)


def zipped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Element rows of the pbf files of those names in an archive; read where the archive's bytes are."""
    wanted = set(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for name in z.namelist():
                        if name.rpartition("/")[2] in wanted:
                            yield pd.DataFrame(list(pbf.decode(z.read(name))), columns=ELEMENT.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ELEMENT)


def _plain_xml(data: bytes | IO[bytes]) -> Iterator[tuple]:
    """Rows of the elements of a text or an open file; what has been told is dropped from the tree."""
    import xml.etree.ElementTree as ET

    from tessella.sources.element import row

    root, depth = None, 0
    for event, e in ET.iterparse(io.BytesIO(data) if isinstance(data, bytes) else data, ("start", "end")):
        if event == "start":
            root, depth = e if root is None else root, depth + 1
            continue
        depth -= 1
        if depth == 1:
            root.clear()
        if e.tag not in ("bounds", "node", "way", "relation") or e.get("action") == "delete":
            continue
        tags = [(t.get("k"), t.get("v", "")) for t in e.iter("tag")]
        if e.tag == "bounds":
            yield row("bounds", box=[float(e.get(k)) for k in ("minlat", "minlon", "maxlat", "maxlon")])
        elif e.tag == "node" and None not in (e.get("id"), e.get("lat"), e.get("lon")):
            yield row("node", int(e.get("id")), int(e.get("version", 0)), float(e.get("lat")), float(e.get("lon")), tags=tags)
        elif e.tag == "way":
            yield row("way", int(e.get("id")), int(e.get("version", 0)), refs=[int(n.get("ref")) for n in e.iter("nd")], tags=tags)
        elif e.tag == "relation":
            known = [(m.get("type"), int(m.get("ref")), m.get("role", "")) for m in e.iter("member") if m.get("type") in ("node", "way", "relation")]
            yield row("relation", int(e.get("id")), int(e.get("version", 0)), members=known, tags=tags)
        e.clear()


PIECE_ROWS = 50_000  # rows that are Python objects at a time


def opening(form: str, box: tuple[float, float, float, float] | None = None, versions: bool = False) -> bytes:
    """The head of a file; box: bottom, left, top, right in degrees."""
    if form == "xml":
        return gzip.compress(xml.opening(box, versions), mtime=0)
    return pbf.encode([], box) if form == "pbf" else o5m.encode([], box)[:-1]


def piece(form: str, rows: list[tuple]) -> bytes:
    """Rows of nodes, ways or relations, in this order, as a part of a file: parts stand one after another."""
    if form == "xml":
        return gzip.compress(xml.elements(rows), mtime=0)
    return pbf.encode(rows)[len(pbf.encode([])) :] if form == "pbf" else o5m.encode(rows)[len(o5m.encode([])) - 1 : -1]


def closing(form: str) -> bytes:
    return {"pbf": b"", "o5m": bytes([o5m.END]), "xml": gzip.compress(xml.CLOSING, mtime=0)}[form]


def _in_order(elements: DataFrame) -> DataFrame:
    return elements.withColumn("nth", F.when(F.col("kind") == "node", 0).when(F.col("kind") == "way", 1).otherwise(2))


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    told = batch.select(["kind", "id", "version", "lat", "lon", "refs", "members", "tags"]).to_pylist()
    return [(r["kind"], r["id"], r["version"], r["lat"], r["lon"], r["refs"], None if r["members"] is None else [(m["type"], m["ref"], m["role"]) for m in r["members"]], [(t["k"], t["v"]) for t in r["tags"] or ()], None) for r in told]


def whole_file(elements: DataFrame, path: str, form: str = "pbf") -> None:
    """All elements as one file: ranges of them are encoded side by side, and the driver strings the parts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([piece(form, _rows(batch))], pa.binary())], names=["data"])

    parts = _in_order(elements.where("kind <> 'bounds'").withColumn("version", F.lit(0))).orderBy("nth", "id")
    data = parts.select(*ELEMENT.names[:-1]).mapInArrow(run, "data binary")
    storage.save(path, chain([opening(form)], (bytes(r.data) for r in data.toLocalIterator()), [closing(form)]))
