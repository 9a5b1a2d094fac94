"""What the start of training is made from, against a plain count over all training documents."""

import numpy as np

from tessella.llm import hmm as H


def test_contexts_take_in_every_training_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = np.zeros((50, 8), np.int64)
    group = np.random.default_rng(5).permutation(50) % 8
    for r in docs.collect():
        if not H.held_out(r.doc_id):
            kinds = [H.word_class(w, 50) for w in [*(r.text or "").encode().lower().split(), b""]]
            for i, k in enumerate(kinds):
                for j in range(max(0, i - 3), min(len(kinds), i + 4)):
                    if j != i:
                        want[k, group[kinds[j]]] += 1
    blocks = H.encode(docs.repartition(3), 3000, 50)
    assert blocks.count() > 5 and want.sum() > 10_000
    assert (H.contexts(blocks, 50, 8, 3) == want).all()
    assert H.contexts(H.encode(docs.limit(0), 3000, 50), 50) is None
