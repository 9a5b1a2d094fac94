"""The language model against a plain version."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tessella.llm import hmm as H


def toy(r, states=3, classes=5):
    x = np.random.default_rng(r)
    return H.Model(x.dirichlet(np.ones(states)), x.dirichlet(np.ones(states), states), x.dirichlet(np.ones(classes), states).T)


def paths(model, seq):
    """Likelihood and state posteriors by going through all state paths."""
    import itertools

    k, total, post = len(model.start), 0.0, np.zeros((len(seq), len(model.start)))
    for p in itertools.product(range(k), repeat=len(seq)):
        v = model.start[p[0]] * model.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            v *= model.move[p[t - 1], p[t]] * model.emit[seq[t], p[t]]
        total += v
        for t, s in enumerate(p):
            post[t, s] += v
    return total, post / total


def test_forward_and_counts():
    r = random.Random(1)
    model = toy(1)
    seqs = [[r.randrange(5) for _ in range(r.randint(1, 6))] for _ in range(9)]
    kinds, sizes = np.array(sum(seqs, [])), np.array(list(map(len, seqs)))
    want = [paths(model, s) for s in seqs]
    assert np.allclose(H.forward(model, kinds, sizes), [math.log10(w) for w, _ in want])
    got = H.expect(model, kinds, sizes, np.ones(len(seqs), bool))
    emit = np.zeros((5, 3))
    for s, (_, post) in zip(seqs, want):
        for t, c in enumerate(s):
            emit[c] += post[t]
    assert np.allclose(got.emit, emit) and np.allclose(got.start, sum(p[0] for _, p in want))
    assert np.isclose(got.move.sum(), sum(map(len, seqs)) - len(seqs))


def test_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (10**6, ""), (10**6, ""), (10**6 + 1, "Zz " * 3000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = H.language_model(docs, passes=2, block=150_000).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id < 10**6]  # the corpus' own texts, not one word 3,000 times
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert H.language_model(docs.limit(0)).count() == 0
