"""The start of training, with a first block that holds no text to learn from."""

import random

from tessella.llm import hmm as H


def test_states_differ_whatever_the_blocks(spark):
    r = random.Random(2)
    topics = [[f"{c}{r.randrange(10**6)}" for _ in range(60)] for c in "abcd"]
    rows = [(i, " ".join(r.choices(topics[i % 4], k=120))) for i in range(600)]
    empty = spark.createDataFrame([(10**6, "")], "doc_id long, text string").repartition(1)
    for odd_first in (True, False):
        text = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        docs = empty.union(text) if odd_first else text.union(empty)
        blocks = H.encode(docs, 5_000)
        counts, _ = H.count_words(blocks)
        model = H.train(blocks, counts)
        assert H.apart(model) > 0.05
        got = [x for x in H.language_model(docs, block=5_000).collect() if x.held_out]
        assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.2 * sum(x.n_tokens for x in got)
