"""Elements as bytes by column: the same elements as those told row by row."""

import gzip
import io
import random

import pyarrow as pa
import pytest

from tessella.sources import columns, maps, o5m, pbf
from tessella.sources.element import row

SCHEMA = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))])
ODD = ["", "é", "a'b\"<&>\n\t\r", "x" * 249, "y" * 300, "名", "outer", "outer", "outer"]


def batch(rows):
    as_dict = lambda r: {"kind": r[0], "id": r[1], "version": r[2], "lat": r[3], "lon": r[4], "refs": r[5], "members": None if r[6] is None else [dict(zip(("type", "ref", "role"), m, strict=True)) for m in r[6]], "tags": [{"k": k, "v": v} for k, v in r[7]]}
    return pa.RecordBatch.from_pylist([as_dict(r) for r in rows], SCHEMA)


def mixed(n, seed=5, texts=ODD):
    rnd = random.Random(seed)
    number = lambda: rnd.choice([0, 1, 127, 128, -1, -300, 2**31, 2**40, -(2**40), rnd.randrange(10**9)])
    tags = lambda: [(rnd.choice(texts) or "k", rnd.choice(texts)) for _ in range(rnd.choice([0, 0, 1, 3]))]
    rows = [row("node", i * 3, rnd.choice([0, 1, 200]), rnd.uniform(-90, 90), rnd.uniform(-180, 180), tags=tags()) for i in range(1, n)]
    rows += [row("way", i * 3, rnd.choice([0, 1, 200]), refs=[number() for _ in range(rnd.choice([0, 1, 2, 200]))], tags=tags()) for i in range(1, n)]
    rows += [row("relation", i * 3, rnd.choice([0, 7]), members=[(rnd.choice(columns.KINDS), number() or 1, rnd.choice([*texts, None])) for _ in range(rnd.choice([0, 1, 30]))], tags=tags()) for i in range(1, n)]
    return rows


def read(form, data):
    whole = maps.opening(form) + data + maps.closing(form)
    return list(pbf.decode(whole) if form == "pbf" else o5m.decode(whole) if form == "o5m" else maps._plain_xml(io.BytesIO(gzip.decompress(whole)).getvalue()))


@pytest.mark.parametrize("form", ["pbf", "o5m", "xml"])
@pytest.mark.parametrize("n", [2, 300, 9000])
def test_as_row_by_row(form, n):
    rows = mixed(n)
    whole = batch([rows[0], *rows])
    got, want = read(form, columns.piece(form, whole.slice(1))), read(form, maps.piece(form, rows))
    assert len(got) == len(rows)
    assert got == want


def test_o5m_is_told_as_before():
    rows = mixed(200)
    for kind in columns.KINDS:
        own = [r for r in rows if r[0] == kind]
        assert columns.piece("o5m", batch(own)) == maps.piece("o5m", own)


def test_more_pairs_than_the_table_holds():
    many = [row("way", i, 1, refs=[i], tags=[("k", str(i % 16_000)), ("same", "yes")]) for i in range(1, 40_000)]
    one = [row("way", 9, 1, refs=[1], tags=[("k", str(i)) for i in range(20_000)] + [("k", "0")]), row("way", 10, 1, refs=[2], tags=[("k", "0")])]
    for rows in (many, one):
        assert read("o5m", columns.piece("o5m", batch(rows))) == rows
    assert len(columns.piece("o5m", batch(many))) < 1.2 * len(maps.piece("o5m", many))


@pytest.mark.parametrize("form", ["pbf", "o5m"])
def test_unknown_kind_of_member(form):
    with pytest.raises(ValueError):
        columns.piece(form, batch([row("relation", 1, 1, members=[("area", 1, "")])]))
