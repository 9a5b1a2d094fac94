"""Fingerprints and components against a plain version."""

import random

import numpy as np
import xxhash

from tessella.llm import simhash as S
from tessella.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_near_duplicates(spark):
    r = random.Random(5)
    base = ["".join(r.choices("abcdef", k=5)) for _ in range(400)]
    texts = [None, "", " \t", "one two", "One  TWO"]
    for _ in range(25):
        w = r.choices(base, k=150)
        texts.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = r.choice(base)
            texts.append(" ".join(v))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    got = {x.doc_id: x for x in S.near_duplicates(df).collect()}
    f = {i: plain(t) for i, t in zip(ids, texts)}
    n = len(ids)
    pairs = [(a, b) for a in range(n) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 4]
    want = roots(n, pairs)
    assert len(pairs) > 40
    for i in ids:
        assert got[i].fp % (1 << 64) == f[i]
        assert got[i].component_id == want[i]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_links_are_whole_for_many_thresholds(spark):
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    at = {x: i for i, x in enumerate(fps)}
    for t, block in ((4, 1 << 15), (4, 8), (3, 1 << 15), (7, 1 << 15)):
        got = [(at[a % (1 << 64)], at[b % (1 << 64)]) for a, b in S.links(df, t, block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in got)
        want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= t]
        assert roots(len(fps), got) == roots(len(fps), want)


def test_wider_parts_find_the_same_links(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(60)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    at = {x: i for i, x in enumerate(fps)}
    sent = []
    for t, together in ((4, 2), (4, 3), (3, 2), (2, 3), (1, 2)):
        anchors = S.Anchors(t, together)
        got = [(at[a % (1 << 64)], at[b % (1 << 64)]) for a, b in S.links(df, t, anchors=anchors).collect()]
        want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= t]
        assert roots(len(fps), got) == roots(len(fps), want)
        sent.append(len(anchors.deal(np.array(fps[:1], np.uint64))[0]))
    assert sent[0] < 200 and sent[1] < 600
    assert [len(S.Anchors.for_many(4, n).parts) for n in (10, 1 << 25, 1 << 40)] == [3, 10, 20]


def test_components(spark):
    r = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(120)] + [(400, i) for i in range(401, 450)]
    df = spark.createDataFrame(pairs + [(5, 5), (None, 3)], "a long, b long")
    want = roots(500, pairs)
    got = {x.node: x.root for x in components(df).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(df.limit(0)).count() == 0
