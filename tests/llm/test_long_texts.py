"""Very long texts, repeated rows and null ids in the operators that have no such test of their own."""

from pyspark.sql import functions as F

from tessella.llm import chat, leaks, mixing, simhash

WORDS = [f"word{i * 7919 % 9973}" for i in range(200_000)]
LONG = " ".join(WORDS)  # 1.8 MB


def test_mix(spark):
    docs = spark.createDataFrame([(1, LONG, "a"), (2, "few words", "a"), (None, LONG, None)], "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.word_count(F.col("text")), mixing.code_point_weights).collect()
    assert sorted((str(r.doc_id), r.mix_size) for r in got) == [("1", 200_000), ("2", 2), ("None", 200_000)]
    assert all(r.mix_taken == r.mix_repeats * r.mix_size and r.mix_repeats <= 2 for r in got)


def test_simhash(spark):
    other = LONG.replace("word5 ", "wort5 ")
    docs = spark.createDataFrame([(5, LONG), (7, other), (9, LONG), (9, LONG), (None, "a b c d e"), (11, "quite another text of a few words")], "doc_id long, text string")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 6
    plain = {d: simhash.shingle_hashes((t or "").encode(), 4) for d, t in ((5, LONG), (11, "quite another text of a few words"))}
    for d, fp, _ in got:
        if d in plain:
            want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in plain[d]) > len(plain[d]))
            assert fp & (1 << 64) - 1 == want
    assert {c for d, _, c in got if d in (5, 7, 9)} == {5} and next(c for d, _, c in got if d == 11) == 11


def test_chat(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + " <|im_end|>"), (1, 2, "user", ""), (1, 3, "assistant", "end")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = chat.chat_digests(df).first()
    assert (r.n_turns, r.loss_chars) == (4, len(LONG) + 14)
    assert chat.format_chat(df).count() == 2


def test_leaks(spark):
    item = " ".join(WORDS[150_000:150_040])
    docs = spark.createDataFrame([(1, LONG), (2, "nothing of it"), (None, LONG), (1, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "not there at all")], "item_id long, text string")
    got = leaks.contamination(docs, bench).collect()
    text = " " + LONG + " "
    hit = sum(1 for _ in WORDS[150_000:150_040]) * text.count(f" {item} ")
    assert len(got) == 4 and all((r.n_words, r.n_hit) == ((200_000, hit) if r.n_words > 9 else (3, 0)) for r in got)
