"""Round trips of all formats, and readers' treatment of broken input."""

import bz2
import gzip
import random

import pytest

from tessella.sources import maps, o5m, pbf, texts, xml
from tessella.sources.element import nodes, relations, row, ways


def elements(seed=1):
    r = random.Random(seed)
    tag = lambda: [(r.choice(["name", "a&b", "k<\"'", "é" * 100]), r.choice(["v", "x\ty\nz", "<&>\"'", "w" * 200])) for _ in range(r.randint(0, 3))]
    out = [row("node", i * 7 - 50, r.choice([0, 1, 5]), r.randint(-90 * 10**7, 90 * 10**7) / 1e7, r.randint(-180 * 10**7, 180 * 10**7) / 1e7, tags=tag()) for i in range(1, 300)]
    out += [row("way", 10**10 + i, r.choice([0, 2]), refs=[r.randint(-(2**40), 2**40) for _ in range(r.randint(0, 9))], tags=tag()) for i in range(60)]
    return out + [row("relation", i + 1, 3, members=[(r.choice(["node", "way", "relation"]), r.randint(1, 2**36), r.choice(["", "inner", "outer"])) for _ in range(r.randint(0, 5))], tags=tag()) for i in range(40)]


BOX = (10.5, -20.25, 30.125, 40.0)


def plain(rows, digits=6):
    f = lambda v: None if v is None else round(v, digits)
    return sorted((k, i, f(la), f(lo), tuple(rf or ()) if k == "way" else None, tuple(map(tuple, m or ())) if k == "relation" else None, tuple(map(tuple, t))) for k, i, _, la, lo, rf, m, t, _ in rows if k != "bounds")


@pytest.mark.parametrize(("form", "digits"), [(pbf, 6), (o5m, 5)])
def test_binary_round_trips(form, digits):
    got = list(form.decode(form.encode(elements(), BOX)))
    assert [x[8] for x in got if x[0] == "bounds"][0] == pytest.approx(list(BOX), abs=1e-6)
    assert plain(got, digits) == plain(elements(), digits) or all(abs((a[2] or 0) - (b[2] or 0)) < 2e-6 and a[:2] + a[4:] == b[:2] + b[4:] for a, b in zip(plain(got, 9), plain(elements(), 9)))
    assert list(form.decode(form.encode([]))) == []


def test_o5m_long_string_table():
    rows = [row("node", i, 0, 1.0, 2.0, tags=[("k", str(i % 16_000))]) for i in range(1, 40_000)]
    assert [x[7] for x in o5m.decode(o5m.encode(rows))] == [x[7] for x in rows]


def test_pbf_refuses_unknown_features():
    from tessella.sources.wire import field

    with pytest.raises(pbf.FormatError):
        list(pbf.decode(pbf._blob("OSMHeader", field(4, b"Other"))))


def test_files(spark, tmp_path):
    rows = elements()
    data = xml.encode(rows, BOX)
    files = {"a.osm": data, "a.osm.gz": gzip.compress(data), "a.osm.bz2": bz2.compress(data), "a.osm.pbf": pbf.encode(rows, BOX), "a.o5m": o5m.encode(rows, BOX)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
        df = maps.read_elements(spark, [str(tmp_path / name)])
        assert nodes(df).count() == 299 and ways(df).count() == 60 and relations(df).count() == 40
        got = [(r.kind, r.id, r.version, r.lat, r.lon, r.refs, [tuple(m) for m in r.members or ()], [tuple(t) for t in r.tags], None) for r in df.where("kind <> 'bounds'").collect()]
        for a, b in zip(plain(got, 9), plain(rows, 9)):
            assert a[:2] == b[:2] and abs((a[2] or 0) - (b[2] or 0)) < 2e-6 and a[4:6] == b[4:6] and len(a[6]) == len(b[6])
        assert df.where("kind = 'bounds'").count() == 1


def test_xml_odd_input(spark, tmp_path):
    (tmp_path / "x.osm").write_text("<osm version='0.6'><bound box='1,2,3,4'/><bound box='1,2'/><node id='1' lat='1' lon='2'/><node id='2' lat='1'/><node id='3' lat='1' lon='2' action='delete'/><way id='4'><nd ref='1'/><nd ref='1'/></way><relation id='5'><member type='what' ref='1' role=''/><member type='node' ref='1'/><tag k='created_by' v='x'/></relation></osm>")
    df = maps.read_elements(spark, [str(tmp_path / "x.osm")])
    assert [r.id for r in nodes(df).collect()] == [1]
    assert ways(df).first().refs == [1, 1]
    rel = relations(df).first()
    assert [tuple(m) for m in rel.members] == [("node", 1, "")] and rel.tags == []
    assert [r.box for r in df.where("kind = 'bounds'").collect()] == [[1.0, 2.0, 3.0, 4.0]]


def test_texts(spark):
    areas = [(63240001, (2207744, 79872, 2334720, 188416)), (63240002, (-10, -20, 30, 40))]
    assert texts.read_area_list(texts.write_area_list(areas)) == areas
    assert texts.read_area_list("63240001: 0x10,-0x20 to 0x30,0x40") == [(63240001, (16, -32, 48, 64))]
    assert texts.read_kml(texts.write_kml(areas)) == areas
    for bad in ("63240001: 1,2", "63240001: 5,5 to 1,1"):
        with pytest.raises(texts.TextError):
            texts.read_area_list(bad)
    problems = [("way", 5), ("rel", 2), ("way", -3)]
    lines = [r.value for r in texts.problem_lines(spark.createDataFrame(problems, "kind string, id long")).collect()]
    assert sorted(texts.read_problems("\n".join([*lines, "# note", "way:7 # x"]))) == sorted([*problems, ("way", 7)])
    with pytest.raises(texts.TextError):
        texts.read_problems("node: 5")
    cells = [(1, 2, 3), (0, 5, 1)]
    assert texts.read_density(texts.write_density(cells, (1, 2, 3, 4))) == (sorted(cells), (1, 2, 3, 4), None)
    assert texts.read_density(texts.write_density(cells, (1, 2, 3, 4), (5, 6, 7, 8)))[1:] == ((1, 2, 3, 4), (5, 6, 7, 8))
    name, rings = texts.read_poly("p\n1\n 0 0\n 10 0\n 10 10\n 0 10\nEND\n!2\n 4 4\n 6 4\n 6 6\n 4 6\nEND\nEND\n")
    assert name == "p" and texts.in_rings(rings, 2, 2) and not texts.in_rings(rings, 5, 5) and not texts.in_rings(rings, 11, 5)
    with pytest.raises(texts.TextError):
        texts.read_poly("p\n1\n 0 0\n 10 10\n 10 0\n 0 10\nEND\nEND\n")
    assert texts.read_sea_index("0_0;sea\n32768_0;land\n0_32768;x.osm.pbf\n99_99;sea\n", (0, 0, 40000, 40000)) == {"sea": ["0_0", "99_99"], "land": ["32768_0"], "files": ["x.osm.pbf"]}
    assert "description: X" in texts.write_template([(1, "X")]) and "mapname: 00000009" in texts.write_template([(1, None)], first_id=9)


class Slow:
    """A file that gives a few bytes at a time and counts what it gave."""

    def __init__(self, data, most):
        self.data, self.most, self.at = data, most, 0

    def read(self, n):
        out = self.data[self.at : self.at + min(n, self.most)]
        self.at += len(out)
        return out


def test_o5m_by_blocks():
    data = o5m.encode(elements(), BOX)
    want = list(o5m.decode(data))
    for most in (1, 7, 1000):
        assert list(o5m.decode(Slow(data, most))) == want
    slow = Slow(data, 64)
    rows = o5m.decode(slow)
    next(rows), next(rows)
    assert slow.at < len(data) // 10
    for broken in (data[:-200], data[:5]):
        with pytest.raises((EOFError, ValueError)):
            list(o5m.decode(Slow(broken, 50)))


def test_o5m_rows_are_not_held(spark, tmp_path):
    """Of a file that is cut off, first rows arrive before its end is looked at: no list of all is made."""
    rows = [row("node", i, 0, 1.0, 2.0) for i in range(1, 100_000)]
    data = o5m.encode(rows)
    (tmp_path / "a.o5m").write_bytes(data[: len(data) // 2])
    assert maps.read_elements(spark, [str(tmp_path / "a.o5m")]).limit(5).count() == 5
