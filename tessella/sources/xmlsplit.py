"""XML map files in one scan of all kinds of elements: a data source with byte ranges that begin and end at elements.

A plain file is cut into ranges. A task goes to the first element that begins in its range and reads on until one begins
beyond it, so every element is read once, by the task in whose range it begins. A compressed file is one range. Elements
stand under any parents (lists of changes, too); borders are found by the elements' tags, so a comment that holds such a
tag right behind a border would be read as an element.
"""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.schema import ELEMENT
from tessella.sources import storage
from tessella.sources.element import row

BEGIN = re.compile(rb"<(?:node|way|relation|bounds?)(?=[\s/>])")
SPLIT, BLOCK = 64 << 20, 1 << 20
MEMBERS = ("node", "way", "relation")


class XmlSource(DataSource):
    """spark.read.format("map_xml").load(path): a file or a folder of files that sources.storage opens; option kinds."""

    @classmethod
    def name(cls) -> str:
        return "map_xml"

    def schema(self):
        return ELEMENT

    def reader(self, schema):
        return _Reader(self.options["path"], tuple(self.options["kinds"].split(",")), int(self.options.get("split", SPLIT)))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: tuple[str, ...], split: int) -> None:
        self.path, self.kinds, self.split = path, kinds, split

    def partitions(self) -> list[_Range]:
        parts = []
        for name, size in storage.files(self.path):
            if name.endswith((".gz", ".bz2")):
                parts.append(_Range(name, 0, None))
            else:
                parts += [_Range(name, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return parts or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.path:
            yield from elements(partition.path, partition.start, partition.end, self.kinds)


def elements(path: str, start: int, end: int | None, kinds: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of the elements that begin from start on and before end."""
    with storage.open_input(path) as raw:
        f = gzip.open(raw) if path.endswith(".gz") else bz2.open(raw) if path.endswith(".bz2") else raw
        if start:
            f.seek(start)
        at, held = start, b""  # held: what stands from at on and was read
        while True:
            while (m := BEGIN.search(held)) is None:  # to the next element
                if not (more := f.read(BLOCK)):
                    return
                kept = held[-16:]
                at, held = at + len(held) - len(kept), kept + more
            at, held = at + m.start(), held[m.start() :]
            if end is not None and at >= end:
                return
            run = _Run(at, end, kinds)
            while held and not run.past:
                try:
                    run.parser.Parse(held)
                except expat.ExpatError as e:
                    yield from run.taken()
                    if e.code not in OUTER or run.depth > 1:
                        raise
                    beyond = run.base + run.parser.ErrorByteIndex - len(ROOT) + 1  # an outer element ends here: go on behind it
                    at, held = max(at, beyond), held[max(0, beyond - at) :]
                    break
                yield from run.taken()
                at, held = at + len(held), f.read(BLOCK)
            else:
                if not held and run.depth > 1 and not run.past:
                    raise EOFError(f"{path} ends within an element")
                return


ROOT = b"<osm>"
OUTER = {expat.errors.codes[e] for e in (expat.errors.XML_ERROR_TAG_MISMATCH, expat.errors.XML_ERROR_JUNK_AFTER_DOC_ELEMENT)}


class _Run:
    """Parses a stretch of elements that follow each other; its own root stands around them."""

    def __init__(self, base: int, end: int | None, kinds: tuple[str, ...]) -> None:
        self.base, self.end, self.kinds = base, end, kinds
        self.depth, self.past, self.rows = 0, False, []
        self.parser = expat.ParserCreate("UTF-8")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.begin, self.finish
        self.parser.Parse(ROOT)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def begin(self, name: str, a: dict[str, str]) -> None:
        self.depth += 1
        if self.past:
            return
        if self.depth == 2:
            if self.end is not None and self.base + self.parser.CurrentByteIndex - len(ROOT) >= self.end:
                self.past = True
            self.name, self.a, self.tags, self.refs, self.members = name, a, [], [], []
        elif self.depth == 3:
            if name == "tag":
                self.tags.append((a.get("k"), a.get("v", "")))
            elif name == "nd":
                self.refs.append(_int(a.get("ref")))
            elif name == "member" and a.get("type") in MEMBERS:
                self.members.append((a["type"], _int(a.get("ref")), a.get("role", "")))

    def finish(self, name: str) -> None:
        self.depth -= 1
        if self.depth == 1 and not self.past:
            self.rows += made(self.name, self.a, self.tags, self.refs, self.members, self.kinds)


def _int(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _numbers(texts: list[str | None]) -> list[float] | None:
    try:
        return [float(t) for t in texts]
    except (TypeError, ValueError):
        return None


def made(name: str, a: dict[str, str], tags: list, refs: list, members: list, kinds: tuple[str, ...]) -> list[tuple]:
    """The row of an element; none for deleted and incomplete ones and for kinds that are not asked for."""
    if name in ("bounds", "bound"):
        box = _numbers([a.get(k) for k in ("minlat", "minlon", "maxlat", "maxlon")] if name == "bounds" else a.get("box", "").split(","))
        return [row("bounds", box=box)] if "bounds" in kinds and box and len(box) == 4 else []
    id_, version = _int(a.get("id")), _int(a.get("version")) or 0
    if name not in kinds or id_ is None or a.get("action") == "delete":
        return []
    if name == "node":
        place = _numbers([a.get("lat"), a.get("lon")])
        return [row("node", id_, version, *place, tags=tags)] if place else []
    return [row("way", id_, version, refs=refs, tags=tags) if name == "way" else row("relation", id_, version, members=members, tags=tags)]
