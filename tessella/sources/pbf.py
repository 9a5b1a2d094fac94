"""The protocol-buffer map format: encoder, decoder and a data source with a partition for each run of blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.element import ELEMENT, row
from tessella.sources.storage import open_input
from tessella.sources.wire import field, fields, packed, signed, unpacked, unzigzag, zigzag

KINDS = ["node", "way", "relation"]
FEATURES = ["OsmSchema-V0.6", "DenseNodes"]
GRANULARITY, NANO = 100, 1e-9
BATCH = 8000


class FormatError(ValueError):
    pass


def blobs(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Where each blob begins and how long it is, with its type; nothing is inflated."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise FormatError("cut blob header")
        (n,) = struct.unpack_from(">I", data, at)
        head = dict(fields(data[at + 4 : at + 4 + n]))
        size = head[3]
        start = at + 4 + n
        if start + size > len(data):
            raise FormatError("cut blob")
        yield start, size, head[1].decode()
        at = start + size


def inflate(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise FormatError("unknown compression")


def header(block: bytes) -> tuple | None:
    """The bounds row of a header block, or None; unknown required features are an error."""
    f = fields(block)
    for n, v in f:
        if n == 4 and v.decode() not in FEATURES:
            raise FormatError(f"required feature {v.decode()} is not known")
    box = next((dict(fields(v)) for n, v in f if n == 1), None)
    if box is None:
        return None
    left, right, top, bottom = (unzigzag(box[i]) * NANO for i in (1, 2, 3, 4))
    return row("bounds", box=[bottom, left, top, right])


def _sums(values: list[int]) -> list[int]:
    return list(accumulate((v >> 1) ^ -(v & 1) for v in values))


def primitives(block: bytes) -> Iterator[tuple]:
    f = fields(block)
    texts = [v.decode() for n, v in fields(next(v for n, v in f if n == 1)) if n == 1]
    own = dict((n, v) for n, v in f if n > 2)
    step, lat0, lon0 = own.get(17, GRANULARITY), signed(own.get(19, 0)), signed(own.get(20, 0))
    degree = lambda v, base: (base + step * v) * NANO

    def collect(data: bytes) -> dict[int, list]:
        out: dict[int, list] = {}
        for n, v in fields(data):
            out.setdefault(n, []).append(v)
        return out

    def tags(x: dict[int, list]) -> list[tuple[str, str]]:
        return [(texts[k], texts[v]) for k, v in zip(unpacked(x.get(2, [])), unpacked(x.get(3, [])), strict=True)]

    def version(x: dict[int, list]) -> int:
        return dict(fields(x[4][0])).get(1, 0) if 4 in x else 0

    for group in (v for n, v in f if n == 2):
        for n, data in fields(group):
            x = collect(data)
            if n == 1:
                yield row("node", unzigzag(x[1][0]), version(x), degree(unzigzag(x[8][0]), lat0), degree(unzigzag(x[9][0]), lon0), tags=tags(x))
            elif n == 2:
                ids, lats, lons = (_sums(unpacked(x.get(i, []))) for i in (1, 8, 9))
                versions = unpacked(collect(x[5][0]).get(1, [])) if 5 in x else []
                words = iter(unpacked(x.get(10, [])))
                for i, id_ in enumerate(ids):
                    own_tags = []
                    for k in words:
                        if not k:
                            break
                        own_tags.append((texts[k], texts[next(words)]))
                    yield row("node", id_, versions[i] if versions else 0, degree(lats[i], lat0), degree(lons[i], lon0), tags=own_tags)
            elif n == 3:
                yield row("way", x[1][0], version(x), refs=_sums(unpacked(x.get(8, []))), tags=tags(x))
            elif n == 4:
                roles, refs, kinds = unpacked(x.get(8, [])), _sums(unpacked(x.get(9, []))), unpacked(x.get(10, []))
                yield row("relation", x[1][0], version(x), members=[(KINDS[k], r, texts[s]) for s, r, k in zip(roles, refs, kinds, strict=True)], tags=tags(x))


def decode(data: bytes) -> Iterator[tuple]:
    for start, size, kind in blobs(data):
        block = inflate(data[start : start + size])
        if kind == "OSMHeader":
            if (b := header(block)) is not None:
                yield b
        elif kind == "OSMData":
            yield from primitives(block)


def _blob(kind: str, block: bytes) -> bytes:
    body = field(2, len(block)) + field(3, zlib.compress(block))
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def _nano(degrees: float) -> int:
    return round(degrees / NANO)


def _deltas(values: list[int]) -> list[int]:
    return [zigzag(v - b) for v, b in zip(values, [0, *values], strict=False)]


class _Block:
    def __init__(self) -> None:
        self.texts: dict[str, int] = {"": 0}
        self.groups: list[bytes] = []

    def text(self, s: str) -> int:
        return self.texts.setdefault(s, len(self.texts))

    def tags(self, tags: Iterable[tuple[str, str]]) -> bytes:
        pairs = [(self.text(k), self.text(v)) for k, v in tags]
        return packed(2, [k for k, _ in pairs]) + packed(3, [v for _, v in pairs])

    def add(self, kind: str, rows: list[tuple]) -> None:
        if kind == "node":
            words = [w for r in rows for w in (*(self.text(t) for kv in r[7] for t in kv), 0)]
            place = lambda v: round(_nano(v) / GRANULARITY)
            # dense information has no way to leave a version out; 1 stands for an unknown one
            info = field(5, packed(1, [r[2] or 1 for r in rows]))
            dense = packed(1, _deltas([r[1] for r in rows])) + info + packed(8, _deltas([place(r[3]) for r in rows])) + packed(9, _deltas([place(r[4]) for r in rows]))
            self.groups.append(field(2, dense + (packed(10, words) if any(words) else b"")))
            return
        body = b""
        for r in rows:
            own = field(1, r[1]) + self.tags(r[7]) + (field(4, field(1, r[2])) if r[2] else b"")
            if kind == "way":
                body += field(3, own + packed(8, _deltas(list(r[5]))))
            else:
                m = r[6] or []
                body += field(4, own + packed(8, [self.text(x[2] or "") for x in m]) + packed(9, _deltas([x[1] for x in m])) + packed(10, [KINDS.index(x[0]) for x in m]))
        self.groups.append(body)

    def bytes(self) -> bytes:
        table = b"".join(field(1, s.encode()) for s in self.texts)
        return field(1, table) + b"".join(field(2, g) for g in self.groups)


def encode(rows: Iterable[tuple], box: tuple[float, float, float, float] | None = None, batch: int = BATCH) -> bytes:
    """A file of element rows in the order nodes, ways, relations; box: bottom, left, top, right in degrees."""
    own = field(1, b"".join(field(i, zigzag(_nano(v))) for i, v in ((1, box[1]), (2, box[3]), (3, box[2]), (4, box[0])))) if box else b""
    out = [_blob("OSMHeader", own + b"".join(field(4, f.encode()) for f in FEATURES))]
    by: dict[str, list[tuple]] = {k: [] for k in KINDS}
    for r in rows:
        if r[0] in by:
            by[r[0]].append(r)
    for kind in KINDS:
        for i in range(0, len(by[kind]), batch):
            block = _Block()
            block.add(kind, by[kind][i : i + batch])
            out.append(_blob("OSMData", block.bytes()))
    return b"".join(out)


class _Blobs(InputPartition):
    def __init__(self, path: str, spots: list[tuple[int, int, str]]):
        super().__init__(0)
        self.path, self.spots = path, spots


class PbfSource(DataSource):
    """spark.read.format("map_pbf").load(path): a local path or an address of a store that sources.storage opens.

    For addresses that only Spark opens, read_elements goes by binaryFile instead.
    """

    @classmethod
    def name(cls) -> str:
        return "map_pbf"

    def schema(self):
        return ELEMENT

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    SIZE = 32 << 20

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """Runs of blobs of about SIZE bytes; only their headers are read."""
        parts, held, size = [], [], 0
        with open_input(self.path) as f:
            while head := f.read(4):
                info = dict(fields(f.read(struct.unpack(">I", head)[0])))
                held.append((f.tell(), info[3], info[1].decode()))
                size += info[3]
                f.seek(info[3], 1)
                if size >= self.SIZE:
                    parts.append(_Blobs(self.path, held))
                    held, size = [], 0
        return [*parts, _Blobs(self.path, held)] if held or not parts else parts

    def read(self, partition):
        with open_input(partition.path) as f:
            for start, size, kind in partition.spots:
                f.seek(start)
                block = inflate(f.read(size))
                if kind == "OSMHeader":
                    if (b := header(block)) is not None:
                        yield b
                elif kind == "OSMData":
                    yield from primitives(block)
