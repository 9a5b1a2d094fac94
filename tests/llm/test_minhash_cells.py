"""Large groups of texts that share fingerprints, many of them unlike."""

import random

import numpy as np
import pytest

from tessella.llm import minhash as M
from tests_llm_plain import joined


def group(n, seed=5):
    r = random.Random(seed)
    hub = [f"w{r.randrange(5000)}" for _ in range(200)]
    return [" ".join(str(r.random()) if i in own else w for i, w in enumerate(hub)) for own in ({*r.sample(range(200), r.randint(1, 6))} for _ in range(n))]


def links(sets, roots, least):
    return [(a, b) for b in range(len(sets)) for a in range(b) if roots[a] != roots[b] and M.similarity(sets[a], sets[b]) >= least]


@pytest.mark.parametrize("often, most", [(32, 1 << 16), (0, 1 << 16), (10**6, 50)])
def test_shared(often, most):
    sets = [M.shingles(t.encode(), 5) for t in [*group(60), "a b c", "a b c", "lone words that nobody else has"]]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (M.shared(sets, often, 100, most) == want).all()


@pytest.mark.parametrize("share, volume", [(1024, 1 << 19), (25, 1 << 19), (1024, 6000)])
def test_cells_find_all_links(spark, share, volume):
    texts = group(150)
    n = len(texts)
    sets = [M.shingles(t.encode(), 5) for t in texts]
    roots = [0 if i < 60 else i for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    told = spark.createDataFrame([(at, at + 7, i, roots[i]) for at in (0, 1) for i in range(n) if at == 0 or i % 2], "at int, band long, node long, root long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, size int")
    got = [(x.a, x.b) for x in M.met(told, sizes, rows, 5, 0.8, share, volume).collect()]
    want = links(sets, roots, 0.8)
    same = [(0, i) for i in range(60)]  # these are one component already
    assert len(want) > 100 and joined(n, same + got) == joined(n, same + want)
    assert len(set(joined(n, same + want))) > 10


def test_no_table_has_the_pairs_of_a_group(spark, monkeypatch):
    texts = group(400)
    n, plain, made = len(texts), M.scratch.table, {}

    def table(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(M.scratch, "table", table)
    got = {x.row: x.kept for x in M.near_copies(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")).collect()}
    sets = [M.shingles(t.encode(), 5) for t in texts]
    want = joined(n, links(sets, range(n), 0.8))
    assert [got[i] for i in range(n)] == want and len(set(want)) > 10
    assert max(made.values()) <= M.BANDS * n, made  # all pairs are 79,800
