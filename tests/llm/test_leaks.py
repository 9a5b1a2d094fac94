"""The positional index against plain searches."""

import random
import re

from tessella.llm import leaks as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def wins(bench, width):
    out = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            out.setdefault(tuple(w[i : i + width]), set()).add(item or "")
    return out


def plain(docs, bench, width):
    told, rows = wins(bench, width), []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in told}:
            for a in range(len(w) - n + 1):
                if found := told.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    items |= found
        rows.append((i, len(w), len(hit), sorted(items)))
    return sorted(rows, key=str)


def plain_near(docs, bench, width, span):
    """Any neighbourhood of a word that holds all terms of a window; the rarest term of the corpus leads."""
    told, seen = wins(bench, width), {}
    for _, t in docs:
        for w in words(t):
            seen[w] = seen.get(w, 0) + 1
    rows = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for x, found in told.items():
            if not all(v in seen for v in x):
                continue
            rare = min(x, key=lambda v: (seen[v], v))
            for at in range(len(w)):
                a, e = max(0, at - span), min(len(w), at + span + 1)
                if w[at] == rare and set(x) <= set(w[a:e]):
                    hit |= set(range(a, e))
                    items |= found
        rows.append((i, len(w), len(hit), sorted(items)))
    return sorted(rows, key=str)


def tables(spark):
    r = random.Random(6)
    vocabulary = [*"abcdefgh", "Über", "x1"]
    text = lambda n: r.choice([" ", ", "]).join(r.choices(vocabulary, k=n))
    bench = [(str(i), text(r.randint(1, 12))) for i in range(25)] + [(None, text(6)), ("0", "unknown words only here now"), ("e", None), ("f", "..."), ("g", "b b b b b b")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "b " * 500), (None, bench[3][1]), (5, bench[4][1]), (5, bench[4][1]), (63, bench[5][1].upper())]
    return docs, bench, spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, row int, words string"), spark.createDataFrame([(*x, 1) for x in bench], "item_id string, text string, id int")


def told(df):
    return sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in df.collect()), key=str)


def test_phrases(spark):
    docs, bench, d, b = tables(spark)
    for width in (5, 2):
        assert told(L.contamination(d, b, width)) == plain(docs, bench, width)
    assert told(L.contamination(d, b.limit(0), 5)) == plain(docs, [], 5)
    assert L.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    docs, bench, d, b = tables(spark)
    assert told(L.contamination(d, b, 4, span=5)) == plain_near(docs, bench, 4, 5)


def test_beyond_what_is_broadcast(spark):
    docs, bench, d, b = tables(spark)
    corpus, w = L.tokenized(d), L.windows(b, 5)
    one, two = (sorted(map(tuple, L.matches(corpus, w, few=few).collect())) for few in (500_000, 0))
    assert one == two and one
