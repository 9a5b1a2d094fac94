"""Near copies against brute-force similarity."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import minhash as M


def near(r, words, n, changes):
    """A copy of the words with some replaced."""
    v = list(words)
    for i in r.sample(range(n), changes):
        v[i] = r.choice("abcdefghij") + str(r.random())
    return v


def test_recall_against_brute_force(spark, sf):
    r = random.Random(8)
    texts = [None, "", " \t", "one two", "One  TWO"]
    for _ in range(120):
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        # 1 to 5 changed words leave similarities from 0.95 down to some 0.78
        texts += [" ".join(w), " ".join(near(r, w, 200, r.randint(1, 5)))]
    hub = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(near(r, hub, 200, r.randint(0, 3))) for _ in range(30)]
    sets = [M.shingles((t or "").encode(), 5) for t in texts]
    n = len(texts)
    want = {(b, a) for a in range(n) for b in range(a) if M.similarity(sets[a], sets[b]) >= 0.8}
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for b, a in sorted(want):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(zip(range(n), range(n), texts)), "row long, doc_id long, text string")
    got = {x.doc_id: x.component_id for x in M.near_copies(df).collect()}
    assert len(want) > 100 and set(got) == set(range(n))
    assert all(top(i) == top(c) for i, c in got.items())  # no link below 0.8
    assert sum(got[a] == got[b] for b, a in want) >= 0.99 * len(want)
    kept = {x.doc_id for x in P.drop_near_duplicates(spark, df.select("doc_id", "text"), sf).collect()}
    assert len(kept ^ {top(i) for i in range(n)}) <= 1
    assert M.near_copies(df.limit(0)).count() == 0
    assert M.near_copies(df.where(F.col("row") < 4)).where("component_id = 0").count() == 3


def test_rows_are_decided_one_by_one(spark, sf):
    r = random.Random(9)
    one, two, three, four = ([f"w{r.randrange(5000)}" for _ in range(100)] for _ in range(4))
    copy = lambda w: " ".join(near(r, w, 100, 1))
    rows = [(7, " ".join(one)), (None, copy(one)), (None, " ".join(two)), (None, copy(two)), (None, " ".join(three)), (8, copy(one)), (8, " ".join(four)), (9, "a b c"), (9, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(x.doc_id, x.text) for x in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert len(kept) == 5 and {rows[0], rows[4], rows[6], rows[7]} <= set(kept)
    assert sum(k in (rows[2], rows[3]) for k in kept) == 1
