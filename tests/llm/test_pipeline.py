"""The pipeline's stages, each against a plain version on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import pii, scratch
from tessella.llm.minhash import shingles, similarity
from tessella.llm import toxicity as T
from tests_llm_plain import plain_segments, plain_targets, windows_hit


def test_stages(spark, sf):
    docs = docs_whole = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sizes = {}
    for name, stage in P.STAGES:
        was = {r.doc_id: r.text for r in docs.collect()}
        docs_before, docs = docs, scratch.table(stage(spark, docs, sf), name)
        now = {r.doc_id: r.text for r in docs.collect()}
        sizes[name] = (len(was), len(now))
        assert set(now) <= set(was) and len(now) == docs.count()
        if name != "mixing":
            assert docs.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            model = T.fit(docs_whole, labels, lambda i: ~T.held_out(i))
            for i, t in was.items():
                words = T.tokens(t or "")
                found = plain_segments([w if (w := T.weigh(x, model.weights)) is not None else -model.loss for x in words])
                x = T.excess([T.Segment(0, 0, v) for v in found], len(words), model.k, model.rate)
                assert (i in now) == (T.toxicity(x, model.slope, model.offset) < 0.5)
        if name == "mixing":
            rows = docs.collect()
            sizes_, source = {}, {}
            for x in docs_before.collect():
                source[x.doc_id] = x.source
                sizes_[x.source] = sizes_.get(x.source, 0) + len(re.findall(rb"[^\x20\x09-\x0D]+", (x.text or "").encode()))
            order = sorted(sizes_)
            want = plain_targets(sizes_, {k: (5, 2, 1)[n % 3] for n, k in enumerate(order)}, 1.5 * sum(sizes_.values()), 2.0)
            assert all(x.mix_repeats in (1, 2) and abs(x.mix_target - want[x.source]) < 1e-6 for x in rows)
            for k in order:
                own = [x for x in rows if x.source == k]
                taken = sum(x.mix_repeats * x.mix_size for x in own)
                assert taken <= want[k] + 1e-6 and want[k] - taken <= max(len((t or "").split()) for i, t in was.items() if source[i] == k)
        if name == "near_duplicates":
            f = {i: shingles((t or "").encode(), 5) for i, t in was.items()}
            near = {i: [j for j in f if j != i and similarity(f[i], f[j]) >= 0.8] for i in f}
            for i in was:
                assert i in now or near[i]
            kept = sorted(now)
            assert not any(j in now for i in kept for j in near[i])
        if name == "decontamination":
            for i, t in was.items():
                assert (i in now) == (not windows_hit(t, bench)[1])
        if name == "pii":
            assert all(now[i] == pii.pseudonymize(t)[0] for i, t in was.items())
            assert not any(re.search(r"\d{1,2}@mail", t) and t == was[i] for i, t in now.items())
    assert sizes["near_duplicates"][1] < sizes["near_duplicates"][0]
    assert P.run(spark, sf).count() == docs.count()


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text here", None, "s", 3), (3, "x " * 60_000, "en", None, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() <= 5
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_names_that_stages_use(spark, sf):
    names = ["toxic_score", "toxic_passages", "_row", "row", "kept", "gone_id", "gone_text", "pii_count", "pii_kinds", "key", "whole", "buckets", "words"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in P.STAGES:
        docs = scratch.table(stage(spark, docs, sf), name)
        assert name == "mixing" or docs.columns[5:] == names
        assert all(x[n] == f"{n}{x.doc_id}" for x in docs.collect() for n in names)
