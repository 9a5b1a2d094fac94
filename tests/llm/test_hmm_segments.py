"""E-steps of long documents in segments, and counts over many buckets."""

import numpy as np
import pytest

from tessella.llm import hmm as H


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_segments_change_nothing(most):
    x = np.random.default_rng(4)
    model = H.Model(x.dirichlet(np.ones(3)), x.dirichlet(np.ones(3), 3), x.dirichlet(np.ones(6), 3).T)
    sizes = np.array([1, 7, 64, 3, 130, 20, 21, 1])
    kinds = x.integers(0, 6, sizes.sum())
    want = H._expect(model, kinds, sizes, np.ones(8, bool), np.zeros((8, 3)), np.repeat(model.start[None], 8, axis=0), np.ones((8, 3)))
    assert np.isclose(want.move.sum(), sizes.sum() - 8)
    for segment in (1, 2, 20, 64, 1000):
        whole = {"held": np.zeros(8), "size": sizes, "token": np.arange(len(kinds)), "kind": kinds}
        got = H.expect(model, *H._training(whole, segment), most)
        for a, b in zip(got, want):
            assert np.allclose(a, b)


def test_counts_do_not_depend_on_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    blocks = H.encode(docs, 3000)
    made = []
    for most in (1 << 20, 500):
        counts, words = H.count_words(blocks, most=most)
        rows = sum(len(H.unpack(r.data)["place"]) for r in words.collect())
        made.append((counts.tokens, counts.words, counts.by_class.tolist(), counts.of_class.tolist(), rows))
    assert made[0] == made[1] and made[0][0] > 0
