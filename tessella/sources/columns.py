"""Rows of elements as the bytes of tile files, column by column: numbers and texts of all rows at once, then put together by row.

A ragged is a pair: the bytes of all rows behind each other, and how many each row (or item of a row) has.
"""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.sources import o5m, pbf, xml
from tessella.sources.wire import field

Ragged = tuple[np.ndarray, np.ndarray]
KINDS = ["node", "way", "relation"]
LEVEL = 6  # of gzip, as gzip's own tools have it


def _sum(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def varints(values: np.ndarray) -> Ragged:
    """Each as wire.put_varint has it."""
    v = values.astype(np.int64).view(np.uint64) if values.dtype != np.uint64 else values
    n, k = np.ones(len(v), np.int64), 1
    while k < 10 and (more := v >= np.uint64(1 << 7 * k)).any():
        n, k = n + more, k + 1
    starts = _sum(n)
    out = np.empty(starts[-1], np.uint8)
    for i in range(k):
        at = slice(None) if i == 0 else np.flatnonzero(n > i)
        out[starts[:-1][at] + i] = (v[at] >> np.uint64(7 * i) & np.uint64(0x7F)).astype(np.uint8) | ((n[at] > i + 1).astype(np.uint8) << 7)
    return out, n


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values << 1) ^ (values >> 63)


def deltas(values: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """To the value before, zigzag; where counts are given, each run of so many begins at zero."""
    out = np.diff(values, prepend=0)
    if counts is not None and len(values):
        first = _sum(counts)[:-1][counts > 0]
        out[first] = values[first]
    return zigzag(out)


def by_row(items: Ragged, counts: np.ndarray) -> Ragged:
    """A row for so many items each."""
    return items[0], np.diff(_sum(items[1])[_sum(counts)])


def woven(*parts: Ragged) -> Ragged:
    """Of each row its bytes of all parts, one after another."""
    total = np.sum([n for _, n in parts], axis=0)
    starts = _sum(total)
    out, at = np.empty(starts[-1], np.uint8), starts[:-1]
    for data, n in parts:
        out[np.repeat(at - _sum(n)[:-1], n) + np.arange(len(data))] = data
        at = at + n
    return out, total


def fixed(text: bytes, where: np.ndarray) -> Ragged:
    """The same bytes in the rows where it is true."""
    return np.tile(np.frombuffer(text, np.uint8), int(where.sum())), where * len(text)


def _where(items: Ragged, where: np.ndarray) -> Ragged:
    n = np.zeros(len(where), np.int64)
    n[where] = items[1]
    return items[0], n


def sized(part: Ragged) -> Ragged:
    """With its length before it."""
    return woven(varints(part[1]), part)


def _field(number: int, part: Ragged) -> Ragged:
    """As wire.field, left out where there is nothing."""
    has = part[1] > 0
    return woven(fixed(bytes([number << 3 | 2]), has), _where(varints(part[1][has]), has), part)


def of_texts(a: pa.Array) -> Ragged:
    """The bytes of texts, none of which is null."""
    if not len(a):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets).astype(np.int64)


def _numbers(a: pa.Array, kind: type = np.int64) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(kind)


class _Rows:
    """The columns of elements of one kind; lists are flat, with a count for each row."""

    def __init__(self, b: pa.RecordBatch) -> None:
        of = lambda name: b.column(b.schema.get_field_index(name))
        self.n, self.ids, self.versions = b.num_rows, _numbers(of("id")), _numbers(of("version"))
        self.lats, self.lons = (_numbers(of(c), np.float64) for c in ("lat", "lon"))
        self.n_refs, self.refs = self._list(of("refs"))
        self.n_members, members = self._list(of("members"))
        self.types, self.member_refs, self.roles = members.field("type"), members.field("ref"), pc.fill_null(members.field("role"), "")
        self.n_tags, tags = self._list(of("tags"))
        self.keys, self.values = tags.field("k"), tags.field("v")

    @staticmethod
    def _list(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
        flat = pa.concat_arrays([a.flatten()])  # a struct's fields know nothing of an offset
        return _numbers(pc.list_value_length(a)), flat

    def type_numbers(self) -> np.ndarray:
        found = pc.index_in(self.types, pa.array(KINDS))
        if found.null_count:
            raise ValueError("a member is neither node, way nor relation")
        return _numbers(found)

    def has_version(self) -> np.ndarray:
        return self.versions != 0


# pbf


def _pbf_block(kind: str, r: _Rows) -> bytes:
    words = pa.concat_arrays([x.cast(pa.string()) for x in (r.keys, r.values, r.roles)]).dictionary_encode()
    table = field(1, b"") + b"".join(field(1, s.encode()) for s in words.dictionary.to_pylist())
    number = _numbers(words.indices) + 1
    t = len(r.keys)
    keys, values, roles = number[:t], number[t : 2 * t], number[2 * t :]
    if kind == "node":
        place = lambda v: np.rint(np.rint(v / pbf.NANO) / pbf.GRANULARITY).astype(np.int64)
        all_ = lambda n, v: field(n, varints(v)[0].tobytes())
        info = field(5, all_(1, np.where(r.has_version(), r.versions, 1)))  # see pbf._Block
        group = all_(1, deltas(r.ids)) + info + all_(8, deltas(place(r.lats))) + all_(9, deltas(place(r.lons)))
        if t:
            pairs = by_row(varints(np.column_stack([keys, values]).ravel()), 2 * r.n_tags)
            group += field(10, woven(pairs, fixed(b"\0", np.ones(r.n, bool)))[0].tobytes())
        return field(1, table) + field(2, field(2, group))
    has = r.has_version()
    info = _field(4, woven(fixed(b"\x08", has), _where(varints(r.versions[has]), has)))
    own = [fixed(b"\x08", np.ones(r.n, bool)), varints(r.ids), _field(2, by_row(varints(keys), r.n_tags)), _field(3, by_row(varints(values), r.n_tags)), info]
    if kind == "way":
        own.append(_field(8, by_row(varints(deltas(_numbers(r.refs), r.n_refs)), r.n_refs)))
    else:
        lists = (roles, deltas(_numbers(r.member_refs), r.n_members), r.type_numbers())
        own += [_field(n, by_row(varints(v), r.n_members)) for n, v in zip((8, 9, 10), lists, strict=True)]
    number_ = {"way": 3, "relation": 4}[kind]
    return field(1, table) + field(2, _field(number_, woven(*own))[0].tobytes())


def _pbf(kind: str, b: pa.RecordBatch) -> bytes:
    return b"".join(pbf._blob("OSMData", _pbf_block(kind, _Rows(b.slice(i, pbf.BATCH)))) for i in range(0, b.num_rows, pbf.BATCH))


# o5m


def _joined(parts: list, like: int) -> pa.Array:
    """Parts (arrays of texts, or texts) behind each other; like: how many rows there are."""
    whole = [x.cast(pa.string()) if isinstance(x, pa.Array) else pa.scalar(x) for x in parts]
    return pc.binary_join_element_wise(*whole, "") if like else pa.array([], pa.string())


def _o5m(kind: str, b: pa.RecordBatch) -> bytes:
    """A run that begins with a reset. Runs are halved until no more pairs are new in one than the table holds, so a pair is told once and
    then by its number; a single row with more pairs tells all of them anew."""
    r = _Rows(b)
    pairs = _joined([r.keys, "\0", r.values, "\0"], len(r.keys))
    counts = r.n_tags
    if kind == "relation":
        heads = _joined([pa.array(r.type_numbers()), r.roles, "\0"], len(r.roles))
        # by row: heads, then pairs
        at = np.concatenate([np.repeat(np.arange(r.n), r.n_members) * 2, np.repeat(np.arange(r.n), r.n_tags) * 2 + 1])
        pairs, counts = pa.concat_arrays([heads, pairs]).take(pa.array(np.argsort(at, kind="stable"))), r.n_members + r.n_tags
    words = pairs.dictionary_encode()
    index, lens = _numbers(words.indices), _numbers(pc.binary_length(words.dictionary))
    kept = lens - _numbers(pc.count_substring(words.dictionary, "\0")) <= o5m.LONGEST
    if kept.sum() >= o5m.TABLE:
        if r.n > 1:
            half = r.n // 2
            return _o5m(kind, b.slice(0, half)) + _o5m(kind, b.slice(half))
        kept[:] = False
    first = np.zeros(len(index), bool)
    first[np.unique(index, return_index=True)[1]] = True
    new = first & kept[index]
    nth = np.cumsum(kept) - 1  # the dictionary is in the order of first places
    back = np.cumsum(new) - new - nth[index]
    told = first | ~kept[index]
    items = woven(varints(np.where(told, 0, back)), _where(of_texts(words.dictionary.take(words.indices.filter(pa.array(told)))), told))
    has = r.has_version()
    body = [varints(deltas(r.ids)), woven(_where(varints(r.versions[has]), has), fixed(b"\0", np.ones(r.n, bool)))]
    tags = by_row(items, counts)
    if kind == "node":
        whole = lambda v: np.trunc(v * o5m.SCALE).astype(np.int64)
        body += [varints(deltas(whole(r.lons))), varints(deltas(whole(r.lats))), tags]
    elif kind == "way":
        body += [sized(by_row(varints(deltas(_numbers(r.refs))), r.n_refs)), tags]
    else:
        refs, types, steps = _numbers(r.member_refs), r.type_numbers(), np.zeros(len(r.member_refs), np.int64)
        for k in range(len(KINDS)):
            steps[types == k] = deltas(refs[types == k])
        of_member = np.repeat(np.tile([True, False], r.n), np.column_stack([r.n_members, r.n_tags]).ravel())
        pick = np.repeat(of_member, items[1])
        heads = items[0][pick], items[1][of_member]
        rest = items[0][~pick], items[1][~of_member]
        body += [sized(by_row(woven(varints(steps), heads), r.n_members)), by_row(rest, r.n_tags)]
    code = {"node": o5m.NODE, "way": o5m.WAY, "relation": o5m.RELATION}[kind]
    return bytes([o5m.RESET]) + woven(fixed(bytes([code]), np.ones(r.n, bool)), sized(woven(*body)))[0].tobytes()


# XML


def _xml(kind: str, b: pa.RecordBatch) -> bytes:
    r = _Rows(b)
    words = pa.concat_arrays([x.cast(pa.string()) for x in (r.keys, r.values, r.roles)]).dictionary_encode()
    quoted = pa.array([xml._quoted(s) for s in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    t = len(r.keys)
    tags = by_row(of_texts(_joined(["<tag k=", quoted[:t], " v=", quoted[t : 2 * t], "/>"], t)), r.n_tags)
    inner = [by_row(of_texts(_joined(["<nd ref='", r.refs, "'/>"], len(r.refs))), r.n_refs)]
    known = pc.and_(pc.not_equal(pc.fill_null(r.types, ""), ""), pc.not_equal(pc.fill_null(r.member_refs, 0), 0))  # as xml.elements
    told = known.to_numpy(zero_copy_only=False)
    texts = _joined(["<member type='", r.types.filter(known), "' ref='", r.member_refs.filter(known), "' role=", quoted[2 * t :].filter(known), "/>"], int(told.sum()))
    inner += [by_row(_where(of_texts(texts), told), r.n_members), tags]
    has, all_ = r.has_version(), np.ones(r.n, bool)
    heads = [fixed(f"<{kind} id='".encode(), all_), of_texts(pa.array(r.ids).cast(pa.string())), fixed(b"'", all_)]
    heads += [fixed(b" version='", has), _where(of_texts(pa.array(r.versions[has]).cast(pa.string())), has), fixed(b"'", has)]
    if kind == "node":
        heads.append(of_texts(pa.array([f" lat='{a:.7f}' lon='{o:.7f}'" for a, o in zip(r.lats.tolist(), r.lons.tolist(), strict=True)], pa.string())))
    full = np.sum([n for _, n in inner], axis=0) > 0
    tail = [fixed(f"</{kind}>\n".encode(), full), fixed(b"/>\n", ~full)]
    return gzip.compress(woven(*heads, fixed(b">", full), *inner, *tail)[0].tobytes(), LEVEL, mtime=0)


_FORMS = {"pbf": _pbf, "o5m": _o5m, "xml": _xml}


def piece(form: str, batch: pa.RecordBatch) -> bytes:
    """As maps.piece, of the columns of elements: nodes, ways or relations, in this order."""
    kinds = _numbers(pc.index_in(batch.column(batch.schema.get_field_index("kind")).cast(pa.string()), pa.array(KINDS)))
    ends = np.searchsorted(kinds, np.arange(len(KINDS) + 1))
    return b"".join(_FORMS[form](k, batch.slice(i, j - i)) for k, i, j in zip(KINDS, ends, ends[1:], strict=False) if i < j)
