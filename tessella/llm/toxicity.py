"""Toxic passages as maximum-scoring segments of token log-odds.

Weights: every word and its beginnings (3 to 7 characters) count once per labelled document; the log-odds of the rates
in toxic and other documents have an informative Dirichlet prior (pseudo-documents at the mean of the two rates, a share
of each kind's own, so that the share of toxic labels does not move them), and a feature counts if its odds are clear and
its likelihood ratio is significant among all features tried. A token scores its longest significant
feature, else a small loss, so that random text drifts down. All maximal scoring segments of a text come from one linear scan. By extreme-value theory the best
segment of n harmless tokens exceeds s with probability 1 - exp(-k n exp(-rate s)). The rate solves sum(p(s) exp(rate s)) = 1
over the scores of all tokens of labelled harmless documents, and k is then their maximum-likelihood value. What significant
segments have beyond the text's expected maximum is added up, and a logistic curve fitted on labelled documents turns that
into a probability.

Defined results: null and empty texts have no tokens and score as the curve says for nothing found; without labels of
both kinds the score is the share of toxic labels (0 without labels); repeated labels of a document count as its largest;
null labels are ignored. Texts are scanned whole in linear time, however long they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows

_TOKEN = re.compile(r"[^\W_]+")
BEGINNINGS = range(7, 2, -1)
FIT_ROWS = 20_000


class Model(NamedTuple):
    weights: dict[str, float]
    loss: float
    k: float
    rate: float
    slope: float
    offset: float


class Segment(NamedTuple):
    start: int
    end: int
    score: float


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(text: str) -> set[str]:
    """Words, and beginnings marked by a trailing *."""
    words = set(tokens(text))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


def weigh(token: str, weights: dict[str, float]) -> float | None:
    found = weights.get(token)
    if found is None:
        for n in BEGINNINGS:
            if len(token) >= n and (found := weights.get(token[:n] + "*")) is not None:
                break
    return found


def segments(scored: list[tuple[int, float]], n: int, loss: float) -> list[Segment]:
    """All maximal scoring segments of n tokens that score -loss but for those listed; linear in the list.

    Each candidate keeps the running totals before it and at its end, and the place of the last candidate that begins
    lower. A new positive token follows those places only, and joins the candidate found where that one ends lower.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at the end, last that begins lower
    total, at = 0.0, 0
    for pos, score in scored:
        total -= loss * (pos - at)
        before, total, at = total, total + score, pos + 1
        if score <= 0:
            continue
        start, low, j = pos, before, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, _, low, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((start, pos + 1, low, total, j))
    return [Segment(a, b, y - x) for a, b, x, y, _ in stack]


class Scanner:
    """Scans texts; remembers the weight of words it has met, up to a bound."""

    def __init__(self, weights: dict[str, float], loss: float, held: int = 300_000):
        self.weights, self.loss, self.held, self.met = weights, loss, held, {}

    def scan(self, text: str) -> tuple[list[Segment], int]:
        scored, n = self.scores(text)
        return segments(scored, n, self.loss), n

    def scores(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """Place and score of the tokens that have a weight, and the number of all."""
        words = tokens(text)
        met = self.met
        if new := set(words).difference(met):
            if len(met) > self.held:
                met.clear()
                new = set(words)
            met.update((w, weigh(w, self.weights)) for w in new)
        return [(i, s) for i, s in enumerate(map(met.__getitem__, words)) if s is not None], len(words)


def level(n: int, k: float, rate: float) -> float:
    """The score that the best segment of n harmless tokens is expected to reach."""
    return math.log(max(k * n, 1.0)) / rate if n else 0.0


def excess(found: list[Segment], n: int, k: float, rate: float) -> float:
    """What the segments score beyond that level, in units of the law's decay."""
    at = level(n, k, rate)
    return rate * sum(max(0.0, s.score - at) for s in found)


def decay(scores: dict[float, int], tokens_: int, loss: float) -> float:
    """The positive root of the mean of exp(rate * score) = 1, where the mean score is below 0; else 1.

    scores: how many tokens have which score; all others score -loss.
    """
    rest = tokens_ - sum(scores.values())
    if not any(s > 0 for s in scores) or sum(s * c for s, c in scores.items()) - loss * rest >= 0:
        return 1.0

    def over(rate: float) -> bool:
        return sum(c * math.exp(min(rate * s, 700.0)) for s, c in scores.items()) + rest * math.exp(-rate * loss) > tokens_

    low, high = 0.0, 1.0
    while not over(high):
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def toxicity(x: float, slope: float, offset: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))


def _rows(docs: DataFrame, labels: DataFrame, train, fit_rows: int) -> DataFrame:
    """The labelled documents to learn from: at most fit_rows of them, those whose ids hash lowest."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(train(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(told), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, train, fit_rows: int = FIT_ROWS, prior_weight: float = 0.01, odds_from: float = 3.5, chance: float = 0.05, loss: float = 0.05) -> Model:
    """Learns from labelled rows for which train (a function of the id column) holds.

    fit_rows bounds the labelled rows that are used; they grow no further with the corpus. Every feature that is significant
    and strong enough gets its weight: there is no bound on weights but that of the features of fit_rows texts.
    """
    rows = _rows(docs, labels, train, fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[int(toxic > 0)].update(features(text or ""))
                seen[int(toxic > 0)][""] += 1
            for f in seen[0].keys() | seen[1].keys():
                yield f, seen[1][f], seen[0][f]

    sums = scratch.table(map_rows(rows, count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "features")
    whole = F.col("feature") == ""
    docs1, docs0, tried = (n or 0 for n in sums.agg(F.max(F.when(whole, F.col("n1"))), F.max(F.when(whole, F.col("n0"))), F.count("*")).first())
    if not docs1 or not docs0:
        share = docs1 / (docs1 + docs0) if docs1 + docs0 else 0.0
        return Model({}, loss, 1.0, 1.0, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else math.copysign(40.0, share - 0.5))
    # both kinds weigh the same in the prior and each takes its own share of it, so odds do not depend on the share of toxic labels
    rate1, rate0 = F.col("n1") / docs1, F.col("n0") / docs0
    prior = prior_weight * (rate1 + rate0) / 2
    odds = F.log(rate1 + prior) - F.log(rate0 + prior)
    # significance by the likelihood ratio, which holds for rare features and any share of toxic labels
    part1, part0 = (F.when(n > 0, n * F.log(r / ((F.col("n1") + F.col("n0")) / (docs1 + docs0)))).otherwise(0.0) for n, r in ((F.col("n1"), rate1), (F.col("n0"), rate0)))
    absent1, absent0 = (F.when(d - n > 0, (d - n) * F.log((1 - r) / (1 - (F.col("n1") + F.col("n0")) / (docs1 + docs0)))).otherwise(0.0) for n, r, d in ((F.col("n1"), rate1, docs1), (F.col("n0"), rate0, docs0)))
    score = F.sqrt(F.greatest(F.lit(0.0), 2 * (part1 + part0 + absent1 + absent0)))
    z_from = NormalDist().inv_cdf(1 - chance / (2 * tried))  # by chance alone, some feature passes in `chance` of fits
    best = sums.where("feature <> '' and n1 > 0").select("feature", odds.alias("odds"), score.alias("z")).where((F.col("z") >= z_from) & (F.col("odds") >= odds_from)).select("feature", "odds").collect()  # those of fit_rows texts at most
    weights = {r.feature: r.odds for r in best}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        scanner = Scanner(weights, loss)
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                scored, n = scanner.scores(text or "")
                drawn = Counter(s for _, s in scored) if not toxic else {}
                yield int(toxic > 0), n, [s.score for s in segments(scored, n, loss)], list(drawn), list(drawn.values())

    met = map_rows(rows, scan, "toxic int, n int, scores array<double>, drawn array<double>, times array<int>").collect()  # fit_rows at most
    clean = [r for r in met if not r.toxic and r.n]
    drawn: Counter = Counter()
    for r in clean:
        drawn.update(dict(zip(r.drawn, r.times, strict=True)))
    rate = decay(drawn, sum(r.n for r in clean), loss)
    # exp(rate * best) of harmless documents has mean k n in the tail: the maximum-likelihood k of the Gumbel law
    k = len(clean) / sum(r.n * math.exp(-rate * max(r.scores, default=0.0)) for r in clean) if clean else 1.0
    points = [(excess([Segment(0, 0, s) for s in r.scores], r.n, k, rate), r.toxic) for r in met]
    slope, offset = logistic(points)
    return Model(weights, loss, k, rate, slope, offset)


def logistic(points: list[tuple[float, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            p = toxicity(x, a, b)
            w = p * (1 - p)
            g1, g0 = g1 + (p - y) * x, g0 + p - y
            h11, h01, h00 = h11 + w * x * x, h01 + w * x, h00 + w
        g1, g0, h11, h00 = g1 + ridge * a, g0 + ridge * b, h11 + ridge, h00 + ridge
        det = h11 * h00 - h01 * h01
        da, db = (g1 * h00 - g0 * h01) / det, (g0 * h11 - g1 * h01) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a, b


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score (double) and toxic_passages (array of start, end in tokens, score); one narrow pass."""
    names = [c for c in docs.columns if c not in ("toxic_score", "toxic_passages")]
    at = names.index("text")
    kept = docs.select(*[docs[f"`{c}`"].cast("string").alias("text") if c == "text" else docs[f"`{c}`"] for c in names])
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.weights, model.loss)
        for b in batches:
            scores, passages = [], []
            for x in b.column(at):
                found, n = scanner.scan(x.as_py() or "")
                from_ = level(n, model.k, model.rate)
                scores.append(toxicity(excess(found, n, model.k, model.rate), model.slope, model.offset))
                passages.append([(s.start, s.end, s.score) for s in found if s.score > from_])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(passages, passage)], names=[*b.schema.names, "toxic_score", "toxic_passages"])

    from pyspark.sql.types import DoubleType, StructType, _parse_datatype_string

    schema = StructType(list(kept.schema.fields)).add("toxic_score", DoubleType()).add("toxic_passages", _parse_datatype_string("array<struct<start:int,end:int,score:double>>"))
    return kept.mapInArrow(run, schema)


def held_out(doc_id):
    """Whether crc32 of the id's text leaves 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
