"""Tile files written through a data source with commit messages.

Rows come sorted by tile, in ranges, so that a large tile is spread over several tasks and no task holds one. A task writes
what it has of each tile as a part of its own, piece by piece, under a name that no other attempt has, and tells the parts
in its commit message. The commit notes the parts of the tasks that count in one list; an abort removes all parts. The parts
of a tile then become its file, copied in blocks by one task for each tile, in order, under its name only when complete.
Parts of attempts that were lost are in no list and go with the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessella.functions.tags import element_version
from tessella.operators.bounded import cut, hinted
from tessella.sources import columns, maps, storage
from tessella.sources.element import ELEMENT

LIST = "parts.json"
PIECE_BYTES = 8 << 20  # of columns that are encoded at a time


@dataclass
class Parts(WriterCommitMessage):
    found: list[tuple[int, int, str]]  # map_id, partition, name


class TileParts(DataSource):
    """Options: path (a new folder that only this write uses) and form."""

    @classmethod
    def name(cls) -> str:
        return "tile_parts"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], self.options["form"])


class PartWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, form: str) -> None:
        self.folder, self.form = folder, form

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """Rows (map_id and those of elements, by map_id) become parts; PIECE_ROWS rows or PIECE_BYTES, whichever is less, are held at a time, and a batch."""
        task = TaskContext.get()
        partition, found = task.partitionId() if task else 0, []
        for map_id, pieces in _by_tile(_pieces(iterator, self.form)):
            name = f"{map_id:08d}/{partition:06d}-{uuid.uuid4().hex}"
            storage.save(f"{self.folder}/{name}", pieces)
            found.append((map_id, partition, name))
        return Parts(found)

    def commit(self, messages: list[Parts | None]) -> None:
        found = sorted(tuple(p) for m in messages if m for p in m.found)
        storage.save(f"{self.folder}/{LIST}", (json.dumps({"map_id": m, "nth": n, "name": name}).encode() + b"\n" for m, n, name in found))

    def abort(self, messages: list[Parts | None]) -> None:
        storage.remove(self.folder)


def _pieces(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[tuple[int, bytes]]:
    """(map_id, encoded piece), tile by tile."""
    now, held, n, size = None, [], 0, 0

    def told() -> tuple[int, bytes]:
        return now, columns.piece(form, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("map_id")).to_numpy()
        ends = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for i, j in zip(ends, ends[1:], strict=False):
            if i == j:
                continue
            if held and (ids[i] != now or n >= maps.PIECE_ROWS or size >= PIECE_BYTES):
                yield told()
                held, n, size = [], 0, 0
            held.append(batch.slice(i, j - i))
            now, n, size = int(ids[i]), n + j - i, size + held[-1].nbytes
    if held:
        yield told()


def _by_tile(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Groups neighbours of one tile without holding them."""
    from itertools import groupby

    for map_id, own in groupby(pieces, lambda p: p[0]):
        yield map_id, (data for _, data in own)


def save_tiles(elements: DataFrame, tiles: DataFrame, areas: DataFrame, folder: str, form: str = "pbf", versions: str = "remove") -> None:
    """Writes the file of every area that holds an element into a shared folder or store.

    elements: element rows; tiles: kind, id, areas (sets of area_idx); areas: area_idx, map_id and edges.
    """
    if form not in maps.EXTENSIONS or form == "simulate":
        raise maps.MapError(f"no files of form {form}")
    spark = elements.sparkSession
    lists = {c: F.coalesce(c, F.array().cast(ELEMENT[c].dataType)) for c in ("refs", "members", "tags")}  # Spark goes through all nulls of a batch again for each row that it hands to Python
    own = elements.withColumn("version", element_version(F.col("version"), versions)).withColumns(lists)
    once = cut(maps._in_order(own.join(tiles.select("kind", "id", "areas"), ["kind", "id"])))  # ranges are drawn from a sample, which would read all files once more
    dealt = once.withColumn("area_idx", F.explode("areas")).join(hinted(areas.select("area_idx", "map_id")), "area_idx")
    order = ["map_id", "nth", "id"]
    whole = dealt.select("map_id", "nth", *ELEMENT.names[:-1])
    rows = whole.repartitionByRange(_tasks(spark), *order).sortWithinPartitions(*order).drop("nth")
    parts = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    spark.dataSource.register(TileParts)
    rows.write.format("tile_parts").mode("append").option("path", parts).option("form", form).save()
    _join(spark, parts, areas, folder, form, versions != "remove")
    storage.remove(parts)


def _tasks(spark) -> int:
    """How many ranges are written side by side: by bytes alone adaptive execution would leave a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _join(spark, parts: str, areas: DataFrame, folder: str, form: str, versions: bool) -> None:
    """One task a tile copies its parts behind each other in blocks."""
    told = [json.loads(x) for x in storage.lines(f"{parts}/{LIST}")]
    if not told:
        return
    by = spark.createDataFrame([(t["map_id"], t["nth"], t["name"]) for t in told], "map_id int, nth int, name string")  # a row for each tile and task that has some of it
    edges = ["min_lat", "min_lon", "max_lat", "max_lon"]
    lists = by.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("names"))

    def copy(rows) -> None:
        for r in rows:
            box = tuple(r[k] * 360 / (1 << 24) for k in edges)
            blocks = (b for name in r.names for b in storage.blocks(f"{parts}/{name}"))
            storage.save(f"{folder}/{r.map_id:08d}.{maps.EXTENSIONS[form]}", _framed(form, box, versions, blocks))

    n = len({t["map_id"] for t in told})
    lists.join(areas.select("map_id", *edges), "map_id").repartitionByRange(n, "map_id").foreachPartition(copy)  # few small rows, which would become one task


def _framed(form: str, box: tuple, versions: bool, blocks: Iterator[bytes]) -> Iterator[bytes]:
    yield maps.opening(form, box, versions)
    yield from blocks
    yield maps.closing(form)
