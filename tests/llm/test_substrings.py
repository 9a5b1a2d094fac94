"""Repeated passages against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from tessella.llm import substrings as S


def plain(rows, length=50):
    first = {}
    for i, t in rows:
        d = (t or "").encode()
        for p in range(len(d) - length + 1):
            s = d[p : p + length]
            first[s] = min(first.get(s, S.LAST_ID), S.LAST_ID if i is None else i)
    out = []
    for i, t in rows:
        d = (t or "").encode()
        mark = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if first[d[p : p + length]] < (S.LAST_ID if i is None else i):
                mark[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(d)) if mark[p] and (p == 0 or not mark[p - 1]))
        kept = bytes(c for c, m in zip(d, mark) if not m)
        out.append((i, len(d), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_index_against_a_plain_search():
    r = random.Random(3)
    for length in (24, 50):
        pieces = ["".join(r.choices("ab", k=r.randint(1, 40))).encode() for _ in range(12)]
        parts = [b"".join(r.choices(pieces, k=8)) for _ in range(30)] + [b"a" * 300, b"ab" * 100]
        parts = [p for p in parts if len(p) >= length]
        docs = np.sort(np.array([r.randrange(20) for _ in parts]))
        sizes = np.array([len(p) for p in parts])
        starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        index = S.RunIndex(b"".join(parts), starts, counts, docs, length)
        first = {}
        for d, p in zip(docs.tolist(), parts):
            for i in range(len(p) - length + 1):
                first.setdefault(p[i : i + length], d)
        assert len(index.node_at) == len(first) <= len(index.run_doc) < counts.sum()
        others = parts + [b"".join(r.choices([*pieces, b"c"], k=9)) for _ in range(20)]
        others = [p for p in others if len(p) >= length]
        sizes = np.array([len(p) for p in others])
        found = index.stream(b"".join(others), np.cumsum(sizes) - sizes, sizes - length + 1)
        assert found.tolist() == [first.get(p[i : i + length], S.LAST_ID) for p in others for i in range(len(p) - length + 1)]


@pytest.mark.parametrize("hot", [4096, 1, 0])
def test_small_blocks_and_hot_markers(spark, hot):
    r = random.Random(9)
    bits = ["".join(r.choices("abc é", k=r.randint(5, 90))) for _ in range(12)] + ["x" * 150, "ab" * 60]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 6)))) for i in range(150)] + [(7, "x" * 3000), (400, "x" * 2500), (None, "x" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.cut_repeats(df, block=2000, hot=hot).collect()
    made = sorted(((x.doc_id, x.n_bytes, sum(y.end - y.start for y in x.removed), len(x.removed), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got), key=str)
    assert made == plain(rows)


def test_repeats(spark):
    r = random.Random(8)
    bits = ["".join(r.choices("abcdé ", k=r.randint(5, 120))) for _ in range(25)] + ["x" * 200, "ab" * 90, "y" * 49, "z" * 50]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 8)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (202, rows[3][1]), (None, rows[4][1]), (None, "q" * 80), (203, "x" * 5000), (-5, rows[9][1]), (204, "same " * 30), (204, "x" * 70)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, spans int")
    got = sorted((tuple(x) for x in S.repeat_digests(df).collect()), key=str)
    assert got == plain(rows)
    assert S.repeat_digests(df.limit(0)).count() == 0
