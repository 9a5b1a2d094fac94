"""Benchmark decontamination with a positional inverted index. DataFrame operations only.

The test windows choose the terms. Each window's entries (term and offset) are ranked by how often the term stands in the
corpus. The index holds posting lists (term, row, position) of every window's rarest RARE entries over the whole corpus;
lists are intersected from the rarest on, each moved by its entry's offset. Where they agree, the lists of the window's
other terms follow: they are built for the rows that are left alone, as no other row can match. A window matches where
all its moved lists hold the same position (exact phrase), or where every term has a posting within a span around one of
the rarest term (proximity). Lists meet by row and position, so a frequent term is spread over all its rows.

Defined results: null and empty texts have no words; items without words match nothing; an item shorter than a window
is one window; a null item_id reads as an empty string; repeated rows are judged apart; columns beyond those named are
left alone; texts are taken whole however long they are, each in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 3
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; null: none."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP)
    return F.filter(cut, lambda w: w != "")


def tokenized(docs: DataFrame) -> DataFrame:
    """The corpus as word arrays, written to the shared folder: row, doc_id, words."""
    return scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text").cast("string")).alias("words")), "words")


def windows(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """Distinct windows: id, w (array of words) and the items that hold it; in the shared folder."""
    w = F.col("ws")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
    cut = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text").cast("string")).alias("ws")).where(F.size("ws") > 0)
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, width))).alias("w"))
    return scratch.table(each.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.monotonically_increasing_id().alias("id"), "w", "items"), "windows")


def _few(df: DataFrame, few: int) -> DataFrame:
    """Broadcast after a count of its rows, which hold a word and two numbers; beyond `few` the planner shuffles."""
    return F.broadcast(df) if scratch.small(df, few) else df


def entries(corpus: DataFrame, wins: DataFrame, few: int = 500_000) -> DataFrame:
    """id, term, off, nth of every window whose terms all stand in the corpus; nth 1 is the entry of the rarest term."""
    each = scratch.table(wins.select("id", F.posexplode("w").alias("off", "term")), "entries")
    terms = each.select("term").distinct()
    seen = corpus.select(F.explode("words").alias("term")).join(_few(terms, few), "term").groupBy("term").count()
    by = W.partitionBy("id").orderBy("count", "term", "off")
    ranked = each.join(_few(scratch.table(seen, "frequencies"), few), "term", "left").withColumn("nth", F.row_number().over(by)).withColumn("absent", F.max(F.col("count").isNull()).over(W.partitionBy("id")))
    return scratch.table(ranked.where("not absent").select("id", "term", "off", "nth"), "ranked")


def postings(corpus: DataFrame, terms: DataFrame, few: int = 500_000) -> DataFrame:
    """The index: term, row, pos for the terms given, written to the shared folder."""
    found = corpus.select("row", F.posexplode("words").alias("pos", "term")).join(_few(terms.distinct(), few), "term")
    return scratch.table(found.select("term", "row", "pos"), "postings")


def _agreeing(places: DataFrame, others: DataFrame, index: DataFrame, few: int) -> DataFrame:
    """Those places (id, row, start) at which the lists of all other entries of the window, moved by their offsets, stand too."""
    asked = places.join(_few(others, few), "id").select("id", "row", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    met = asked.join(index, ["term", "row", "pos"]).groupBy("id", "row", "start").agg(F.count("*").alias("met"))
    asks = others.groupBy("id").agg(F.count("*").alias("asks"))
    return met.join(_few(asks, few), "id").where("met = asks").select("id", "row", "start")


def matches(corpus: DataFrame, wins: DataFrame, span: int | None = None, few: int = 500_000) -> DataFrame:
    """id (of a window), row, start, end (word positions) of every match.

    span None: exact phrases. Else proximity: all distinct terms of a window within span words before and after one of
    its rarest term; start and end are then the first and behind the last word of that neighbourhood.
    """
    each = entries(corpus, wins, few)
    size = each.groupBy("id").agg(F.count("*").cast("int").alias("n"))
    first, rare = each.where("nth = 1"), each.where(f"nth > 1 and nth <= {RARE}")
    index = postings(corpus, each.where(f"nth <= {RARE}").select("term"), few)
    places = index.join(_few(first, few), "term").select("id", "row", "pos", (F.col("pos") - F.col("off")).alias("start"))
    if span is not None:
        return _near(corpus, scratch.table(places.select("id", "row", "pos"), "places"), each, span, few)
    places = scratch.table(places.where("start >= 0").select("id", "row", "start"), "places")
    short = places.join(_few(size.where("n = 1"), few), "id").select("id", "row", "start")
    left = scratch.table(short.unionByName(_agreeing(places, rare, index, few)), "agreeing")
    more = each.where(f"nth > {RARE}")
    rows = left.select("row").distinct()
    rest = postings(corpus.join(_few(rows, few), "row", "left_semi"), more.select("term"), few)
    small = left.join(_few(size.where(f"n <= {RARE}"), few), "id").select("id", "row", "start")
    whole = small.unionByName(_agreeing(left, more, rest, few))
    return whole.join(_few(size, few), "id").select("id", "row", "start", (F.col("start") + F.col("n")).alias("end"))


def _near(corpus: DataFrame, places: DataFrame, each: DataFrame, span: int, few: int) -> DataFrame:
    """Places (id, row, pos of the rarest term) with a posting of every term of the window within span words."""
    terms = each.select("id", "term").distinct()
    rest = postings(corpus.join(_few(places.select("row").distinct(), few), "row", "left_semi"), terms.select("term"), few)
    asked = places.join(_few(terms, few), "id").select("id", "row", F.col("pos").alias("at"), "term")
    met = asked.join(rest, ["term", "row"]).where(F.abs(F.col("pos") - F.col("at")) <= span).groupBy("id", "row", "at").agg(F.countDistinct("term").alias("met"))
    asks = terms.groupBy("id").agg(F.count("*").alias("asks"))
    whole = met.join(_few(asks, few), "id").where("met = asks").join(corpus.select("row", F.size("words").alias("n")), "row")
    return whole.select("id", "row", F.greatest(F.col("at") - span, F.lit(0)).alias("start"), F.least(F.col("at") + span + 1, "n").alias("end"))


def covered(spans: Column) -> Column:
    """Number of positions in the union of an array of structs start, end."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), none, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, span: int | None = None) -> DataFrame:
    """row, doc_id, n_words, n_hit and items (array of strings, sorted) of every document; span: see matches."""
    corpus, wins = tokenized(docs), windows(benchmark, width)
    found = scratch.table(matches(corpus, wins, span), "matches")
    hit = found.select("row", "start", "end").distinct().groupBy("row").agg(covered(F.collect_list(F.struct("start", "end"))).cast("long").alias("n_hit"))
    items = found.select("row", "id").distinct().join(wins.select("id", F.explode("items").alias("item")), "id").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = corpus.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(hit.join(items, "row"), "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
