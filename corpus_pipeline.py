"""From raw documents to a training mix, in five stages.

Every stage takes and (but for the last) returns the columns of documents. Rows that repeat both doc_id and text are one
document: they stay or go together, but for the near-duplicate stage, which keeps one row of each group of copies. Null
texts stand for empty ones throughout, and texts are treated whole, however long they are; empty tables pass as they are;
further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.leaks import contamination
from tessella.llm.minhash import few, near_copies
from tessella.llm.mixing import code_point_weights, mix, word_count
from tessella.llm.pii import add_pseudonyms
from tessella.llm.toxicity import fit, held_out, score_toxicity

NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages make label 1 the likelier one go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, lambda i: ~held_out(i))
    return _apart(docs, {"toxic_score", "toxic_passages"}, lambda d: score_toxicity(d, model).where("toxic_score < 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of a similarity of 0.8 or more on five-word shingles join, one with the smallest id stays."""

    def run(docs: DataFrame) -> DataFrame:
        rows = scratch.table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        found = near_copies(rows.select(F.col("_row").alias("row"), "doc_id", "text"), NEAR_WORDS, NEAR_SIMILARITY)
        gone = scratch.table(found.where("row <> kept").select(F.col("row").alias("_row")), "gone")
        return rows.join(few(gone), "_row", "left_anti")

    return _apart(docs, {"_row"}, run)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any benchmark window go: what stays has none, however long it is."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("n_hit > 0").select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.text").alias("gone_text")).distinct()
    d, g = docs.alias("d"), gone.alias("g")
    return d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.gone_id")) & (F.xxhash64("d.text") == F.col("g.gone_text")), "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms of the same format."""
    out = _apart(docs, {"pii_count", "pii_kinds"}, add_pseudonyms)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with the number of times that it is taken; those not taken are left out."""
    return mix(docs, word_count(F.col("text").cast("string")), code_point_weights).where("mix_repeats > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", pseudonyms),
    ("mixing", mix_sources),
]
#: Hashes, fitted weights and keyed permutations are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def _apart(docs: DataFrame, taken: set[str], run) -> DataFrame:
    """What run makes of docs, with the columns of docs alone; those that have a name that run adds are set aside meanwhile."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c.lower() in taken}
    out = run(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
