"""Quality rules: metrics and bounds against plain versions, the verdict against SQL, the promise on rows that were held back."""

import math
import os
import random
import re
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from tessella.llm import catalog, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_metrics():
    r = random.Random(1)
    for n in (0, 1, 7, 8, 9, 16, 40, 200):
        for bits in (["a", "b", "é#", "\U0001f600x"], ["w%d" % i for i in range(90)]):
            text = "".join(r.choice(bits) + r.choice([" ", "\n", "\t\x0b", "\r\n", " "]) for _ in range(n))
            assert quality.measure(text.encode()) == plain(text)
    long = "one two three four five six seven eight nine ten " * 60_000
    assert quality.measure(long.encode())[5] == 600_000
    assert quality.measure(" ".join(map(str, range(500_000))).encode())[:2] == (500_000, 2_888_890)


def test_binomial_bounds_are_exact():
    for n in (1, 5, 59, 90, 200):
        for p in (Fraction(1, 20), Fraction(3, 10), Fraction(9, 10)):
            tail = Fraction(0)
            for r in range(n + 1):
                tail += math.comb(n, r) * p**r * (1 - p) ** (n - r)
                assert abs(quality.binomial_tail(r, n, float(p)) - float(tail)) < 1e-12 + 1e-10 * float(tail)
    assert quality.most_false(58, 0.05, 0.05) == -1 and quality.most_false(59, 0.05, 0.05) == 0 and quality.most_false(93, 0.05, 0.05) == 1
    assert 0.0499 < quality.most_false(10**9, 0.05, 0.01) / 10**9 < 0.05


def plain_cuts(rows, risk, delta):
    """rows: stratum, held, good, bins by rule. Steps one after the other."""
    out, strata = {}, {s for s, held, good, _ in rows if held and good}
    for s in {r[0] for r in rows}:
        first = [(g, b) for t, held, g, b in rows if t == s and not held]
        steps = []
        for rule in quality.bins():
            at = {b[rule] for _, b in first if b[rule] > 0}
            share = {c: (sum(not g and b[rule] >= c for g, b in first) + 1) / (sum(b[rule] >= c for _, b in first) + 2) for c in at}
            steps += [(-max(v for c2, v in share.items() if c2 <= c), rule, -c) for c in at]
        good = [b for t, held, g, b in rows if t == s and held and g]
        taken = {}
        for share, rule, cut in sorted(x for x in steps if -x[0] >= 0.5):
            nxt = taken | {rule: -cut}
            false = sum(any(b[r] >= c for r, c in nxt.items()) for b in good)
            n = len(good)
            if not n or sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(false + 1)) > delta / len(strata):
                break
            taken = nxt
        if taken:
            out[s] = taken
    return out


def test_cutoffs_against_single_steps(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        good, s = r.random() < 0.8, r.choice(["en", "en", "en", "de", None])
        n = r.randint(20, 60)
        rows.append((i, s, n, n * (r.randint(40, 60) if good else r.randint(45, 90)) // 10, 0 if good and r.random() < 0.97 else r.randint(0, 90), r.randint(1, 5), r.choice([0, 0, 0, 1]), 0))
        labels.append((i, int(good)))
    stats = spark.createDataFrame(rows, f"doc_id long, stratum string, {quality.STATS}")
    told = spark.createDataFrame(labels + [(None, 0), (3, None)], "doc_id long, quality int")
    cells = {x.doc_id: x for x in stats.select("doc_id", "stratum", *[v.alias(k) for k, v in quality.bins().items()], quality.in_holdout(F.col("doc_id")).alias("held")).collect()}
    want = plain_cuts([(cells[i].stratum, cells[i].held, g == 1, {k: cells[i][k] for k in quality.bins()}) for i, g in labels], 0.05, 0.05)
    got = {x.stratum: dict(x.cuts) for x in quality.cutoffs(stats, told, quality.in_holdout).collect()}
    assert got == want and "en" in got
    assert quality.cutoffs(stats, told.limit(0), quality.in_holdout).count() == 0


def test_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "word " * 30, "en"), (4, "a b c", "xx"), (5, " ".join(map(str, range(300))), "en"), (5, " ".join(map(str, range(300))), "en"), (6, "x" * 300_000, None)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, lang string, kept string, n_words int")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = quality.judge(df, labels).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in got) == [("1", 0, True, False), ("2", 0, True, False), ("4", 3, True, False), ("5", 300, False, True), ("5", 300, False, True), ("6", 1, True, False), ("None", 30, True, False)]
    assert quality.judge(df.limit(0), labels).count() == 0


def test_promise_on_rows_held_back(spark, sf):
    """Labels of one id in seven are not shown; among those, good rows stay and most of the others go."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    back = F.crc32(F.concat(F.lit("back"), "doc_id").cast("binary")) % 7 == 0
    out = quality.judge(docs, labels.where(~back)).where("not base_failed").join(labels.where(back), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.05 * n[1, True] and n.get((0, False), 0) >= 5 * n.get((0, True), 0)


def test_verdict_against_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    want = sorted(con.execute(catalog.ORACLES["op12_quality"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["op12_quality"](spark, sf).collect())
    assert got == want
    assert sum(not r[-1] and not r[-2] for r in got) > 20
