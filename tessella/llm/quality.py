"""Quality rules whose cutoffs hold a promised rate of false rejections in every stratum.

Rules compare whole-number metrics of a text with cutoffs on a fixed grid. Labelled rows are dealt into two folds by id. The
first fold proposes: in each stratum, every cutoff of every rule is ranked by the share of bad rows among those that it
rejects, as far as that share reaches min_share; along this path the set of rejected rows only grows. The second fold, the
holdout, decides: going along the path, a step is taken while an exact binomial bound shows that fewer than `risk` of the
good rows are rejected by all steps so far together. Tests along a path stop at the first that fails, so they need no
correction among themselves; across strata the error `delta` is divided by their number (Bonferroni). With probability
1 - delta, no stratum loses more than `risk` of its good rows to the rules. Where labels are too few for such a bound,
nothing is rejected but what the fixed base rules reject.

Texts are read once, whole; counts are aggregates over all labelled rows; what a stratum needs is bounded by the grid
(rules times BINS rows).

Defined results: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; rows
without an id have no label; an id that is labelled twice counts as bad if one label says so; rows that repeat an id and
a text count once among the labels; without labels only the base rules reject; empty in, empty out. Columns of docs other
than doc_id, text and the stratum play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows, texts

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BINS, FEW = 200, 50_000
RISK, DELTA, MIN_SHARE = 0.05, 0.05, 0.5


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a run of `width` words (a power of two) that occurs twice or more; exact, by doubling of run numbers."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    runs = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < width:
        runs = np.unique(runs[:-step] * (int(runs.max()) + 1) + runs[step:], return_inverse=True)[1]
        step *= 2
    twice = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    edge[twice + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The numbers of STATS for a text in UTF-8."""
    words = text.split()  # at the six ASCII spaces
    lines = [x for x in text.split(b"\n") if x.strip()]
    going_on = 0 if text.isascii() else int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())  # bytes that begin no character
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    return len(words), sum(map(len, words)) - going_on, symbols, len(lines), len(lines) - len(set(lines)), repeated(words)


def statistics(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and STATS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple]:
        for b in batches:
            for i, s, text in zip(b.column("doc_id").to_pylist(), b.column("stratum").to_pylist(), texts(b), strict=True):
                yield i, s, *measure(text)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, f"doc_id long, stratum string, {STATS}")


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 in 100 words in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bins() -> dict[str, Column]:
    """Rule -> cell of the grid (0 to BINS); a row in a higher cell is the worse one. Only for rows with words."""
    part = lambda a, b, step: F.expr(f"1000 * {a} div greatest(1, {b}) div {step}")
    length = F.expr("10 * word_chars div greatest(1, n_words)")
    of = {
        "dup_lines": part("n_dup_lines", "n_lines", 5),
        "long_words": length,
        "repeats": part("n_repeat_words", "n_words", 5),
        "short_words": BINS - length,
        "symbols": part("n_symbols", "word_chars", 5),
    }
    return {k: F.greatest(F.lit(0), F.least(F.lit(BINS), v)).cast("int") for k, v in of.items()}


def binomial_tail(r: int, n: int, p: float) -> float:
    """P(X <= r) for n draws with probability p, as a regularised incomplete beta function by its continued fraction."""
    if r >= n:
        return 1.0
    return _beta(n - r, r + 1, 1 - p) if r >= 0 else 0.0


def _beta(a: float, b: float, x: float) -> float:
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, m = 1e-300, 0
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    while True:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 1_000_000:
            return front * out


def most_false(n: int, risk: float, error: float) -> int:
    """The largest number of rejected rows among n good ones that still shows a rate below risk, but for an error of that size; -1: none does."""
    low, high = -1, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if binomial_tail(mid, n, risk) * (1 + 1e-9) <= error else (low, mid - 1)
    return low


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if scratch.small(df, FEW) else df


def in_rules(cells: DataFrame, *keep: str) -> DataFrame:
    """keep, rule, bin: a row for each rule of what labelled gives."""
    return cells.select(*keep, F.explode(F.map_from_arrays(F.array(*map(F.lit, bins())), F.col("bins"))).alias("rule", "bin"))


def labelled(stats: DataFrame, labels: DataFrame, holds_out) -> DataFrame:
    """cell, stratum, held, good, bins, n: labelled rows that pass the base rules, counted by stratum, fold, label and cells of the grid."""
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    known = stats.where(~base_failed()).join(told, "doc_id").distinct()
    cells = known.groupBy("stratum", holds_out(F.col("doc_id")).alias("held"), "good", F.array(*bins().values()).alias("bins")).agg(F.count("*").alias("n"))
    return scratch.table(cells.withColumn("cell", F.monotonically_increasing_id()), "labelled")


def path(proposals: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """stratum, rule, bin, step: cutoffs in the order in which they are tried, from 1 on; a row is rejected from its cutoff's bin on.

    proposals: stratum, good, n, rule, bin of the first fold. The share of a cutoff is (bad + 1) / (rows + 2) of all rows from
    it on; a cutoff gets the best share that it or a stricter one of its rule has, so that milder ones come first.
    """
    counts = proposals.where("bin > 0").groupBy("stratum", "rule", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("bad"))
    down = W.partitionBy("stratum", "rule").orderBy(F.col("bin").desc())
    share = (F.sum("bad").over(down) + F.lit(1.0)) / (F.sum("n").over(down) + F.lit(2.0))
    cuts = counts.select("stratum", "rule", "bin", share.alias("share"))
    cuts = cuts.select("stratum", "rule", "bin", F.max("share").over(W.partitionBy("stratum", "rule").orderBy("bin")).alias("share")).where(F.col("share") >= min_share)
    order = W.partitionBy("stratum").orderBy(F.col("share").desc(), "rule", F.col("bin").desc())
    return cuts.select("stratum", "rule", "bin", F.row_number().over(order).alias("step"))


def certified(steps: DataFrame, holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, last: the last step that the good rows of the holdout allow, where there is one.

    holdout: cell, stratum, n, bins of good rows.
    """
    size = holdout.groupBy("stratum").agg(F.sum("n").alias("n"))
    strata = max(1, size.count())

    @F.pandas_udf("long")
    def most(n: pd.Series) -> pd.Series:
        return n.map(lambda x: most_false(int(x), risk, delta / strata))

    # the first step that rejects a bin is that of the mildest cutoff at or below it
    upto = F.lead("bin", 1, BINS + 1).over(W.partitionBy("stratum", "rule").orderBy("bin"))
    grid = steps.withColumn("upto", upto).select("stratum", "rule", "step", F.explode(F.sequence("bin", F.col("upto") - 1)).alias("bin"))
    h, s = in_rules(holdout, "cell", "stratum", "n").alias("h"), _few(grid).alias("s")
    hit = h.join(s, F.col("h.stratum").eqNullSafe(F.col("s.stratum")) & (F.col("h.rule") == F.col("s.rule")) & (F.col("h.bin") == F.col("s.bin")))
    first = hit.groupBy("h.stratum", "h.cell").agg(F.min("s.step").alias("step"), F.first("h.n").alias("n")).groupBy("stratum", "step").agg(F.sum("n").alias("n"))
    a, b = steps.alias("a"), first.alias("b")
    caught = a.join(b, F.col("a.stratum").eqNullSafe(F.col("b.stratum")) & (F.col("a.step") == F.col("b.step")), "left")
    lost = caught.select("a.stratum", "a.step", F.sum(F.coalesce("b.n", F.lit(0))).over(W.partitionBy("a.stratum").orderBy("a.step")).alias("lost"))
    f, n = lost.alias("f"), size.withColumn("most", most("n")).alias("n")
    return f.join(n, F.col("f.stratum").eqNullSafe(F.col("n.stratum"))).where("lost <= most").groupBy("f.stratum").agg(F.max("step").alias("last"))


def cutoffs(stats: DataFrame, labels: DataFrame, holds_out, risk: float = RISK, delta: float = DELTA, min_share: float = MIN_SHARE) -> DataFrame:
    """stratum, cuts (rule -> bin from which a row is rejected) of the strata in which a rule may reject.

    stats: of statistics; labels: doc_id, quality (1: good); holds_out: doc_id column -> whether the row is in the holdout.
    """
    known = labelled(stats, labels, holds_out)
    steps = scratch.table(path(in_rules(known.where("not held"), "stratum", "good", "n"), min_share), "steps")
    last = certified(steps, known.where("held and good"), risk, delta)
    a, b = steps.alias("a"), last.alias("b")
    taken = a.join(b, F.col("a.stratum").eqNullSafe(F.col("b.stratum")) & (F.col("a.step") <= F.col("b.last")))
    strictest = taken.groupBy("a.stratum", "a.rule").agg(F.min("a.bin").alias("bin"))
    return strictest.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bin"))).alias("cuts"))


def in_holdout(doc_id: Column) -> Column:
    """Three fifths of the ids, by checksum."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 >= 2


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", holds_out=in_holdout, risk: float = RISK, delta: float = DELTA, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, stratum, STATS, base_failed, broken (rules whose cutoff the row reaches) and kept, for every row of docs."""
    stats = scratch.table(statistics(docs, stratum), "statistics")
    cuts = scratch.table(cutoffs(stats, labels, holds_out, risk, delta, min_share), "cutoffs")
    a, b = stats.alias("a"), _few(cuts.withColumnRenamed("stratum", "cut_stratum")).alias("b")
    broken = [F.when(v >= F.col("cuts")[k], F.lit(k)) for k, v in bins().items()]
    out = a.join(b, F.col("a.stratum").eqNullSafe(F.col("b.cut_stratum")), "left").withColumn("base_failed", base_failed())
    out = out.withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).select("doc_id", "stratum", *[x.split()[0] for x in STATS.split(", ")], "base_failed", "broken", "kept")
