"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.chat import chat_digests

    told = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return chat_digests(rows.unionByName(extra))


@query
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.ogg import media_digests

    return media_digests(read(spark, sf_dir, "documents"))


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import scratch
    from tessella.llm.mixing import code_point_weights, mix, word_count

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text"), word_count(F.col("text").cast("string")).alias("size"))
    out = mix(scratch.table(rows, "documents"), F.col("size"), code_point_weights)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


@query
def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.leaks import contaminated, contamination

    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit, n = F.col("n_hit"), F.col("n_words")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(hit, n).alias("contaminated"))


ORACLES["op10_leaks"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i + 1:i + 13], ' ') AS s
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, p.n, item FROM places AS p JOIN win ON p.n = win.n AND p.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import near_duplicates

    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import add_pseudonyms

    return add_pseudonyms(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.toxicity import fit, held_out, score_toxicity

    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = fit(docs, labels, lambda i: ~held_out(i))
    out = score_toxicity(docs, model)
    score = F.col("toxic_score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.substrings import repeat_digests

    return repeat_digests(read(spark, sf_dir, "documents"))


@query
def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.hmm import language_model

    return language_model(read(spark, sf_dir, "documents"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.merkle import manifest_digests

    return manifest_digests(read(spark, sf_dir, "documents"))


_CRC = "list_reduce(list_prepend(4294967295, list_transform(flatten(list_transform(range(1, len({0}) + 1), lambda i: list_prepend(CAST(ascii({0}[i]) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]))), lambda v: CAST(v AS BIGINT))), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
_LEAF = "sha256({0} || {1} || {2} || {3} || {4})"


def _field(v: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"


ORACLES["op11_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format(*map(_field, ("doc_id", "source", "lang", "n_chars", "text")))} AS leaf,
    {_LEAF.format(*map(_field, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))} AS touched,
    coalesce(xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL, false) AS hit
  FROM documents),
l AS (
  SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL
  SELECT g, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 2),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
height AS (SELECT g, max(level) AS top FROM nodes GROUP BY g),
runs AS (
  SELECT g, level, i // 2 AS up, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT s.g, top + t.level, t.i // 2, list(t.h ORDER BY t.i) FROM tops t, subroots s, height WHERE t.n > 1 AND s.g = height.g AND t.i // 2 = (s.i >> t.level) // 2 GROUP BY ALL),
fold AS (
  SELECT g, i AS id, 0 AS level, i, CASE WHEN hit THEN touched ELSE leaf END AS h, '' AS sib FROM l
  UNION ALL
  SELECT f.g, f.id, f.level + 1, f.i // 2, sha256(array_to_string(CASE WHEN len(hs) = 1 THEN [f.h] WHEN f.i % 2 = 0 THEN [f.h, hs[2]] ELSE [hs[1], f.h] END, '')), sib || CASE WHEN len(hs) = 1 THEN '' WHEN f.i % 2 = 0 THEN hs[2] ELSE hs[1] END
  FROM (SELECT fold.g, id, fold.level, fold.h, sib, CASE WHEN fold.level = top THEN s.i ELSE fold.i END AS i FROM fold JOIN height USING (g) JOIN subroots s USING (g)) f JOIN runs r ON r.g = f.g AND r.level = f.level AND r.up = f.i // 2),
done AS (SELECT g, id, arg_max(h, level) AS folded_root, arg_max(sib, level) AS sib FROM fold GROUP BY ALL)
SELECT l.doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM l JOIN done ON l.g = done.g AND l.i = done.id JOIN subroots s ON s.g = l.g, (SELECT h FROM tops WHERE n = 1) r
"""


@query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.clusters import cluster_digests

    return cluster_digests(read(spark, sf_dir, "embeddings"))


def _round(j: int) -> str:
    """Assignment to the centroids of turn j, and those of the next turn."""
    return f"""
a{j} AS MATERIALIZED (
  SELECT id, vec_id, x.v, k, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM x, c{j} c QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1),
s{j} AS (SELECT k, p, sum(v[p]) AS s, count(*) AS n FROM a{j}, range(1, 65) t(p) GROUP BY ALL),
m{j} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{j} GROUP BY k),
c{j + 1} AS MATERIALIZED (SELECT k, coalesce(m{j}.v, c{j}.v) AS v FROM c{j} LEFT JOIN m{j} USING (k))"""


ORACLES["op13_clusters"] = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM x QUALIFY k < 16),{",".join(map(_round, range(4)))}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)
"""


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import judge

    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BIN = "CAST(greatest(0, least(200, {0})) AS INTEGER)"
_RULES = {
    "dup_lines": "1000 * n_dup_lines // greatest(1, n_lines) // 5",
    "long_words": "10 * word_chars // greatest(1, n_words)",
    "repeats": "1000 * n_repeat_words // greatest(1, n_words) // 5",
    "short_words": "200 - 10 * word_chars // greatest(1, n_words)",
    "symbols": "1000 * n_symbols // greatest(1, word_chars) // 5",
}
ORACLES["op12_quality"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('+' || lang, '') AS g, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT id, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT id, w, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT id, i FROM win QUALIFY count(*) OVER (PARTITION BY id, s) > 1),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY id),
s AS MATERIALIZED (
  SELECT d.id, doc_id, g, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (id)),
f AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{_BIN.format(v)} AS {k}" for k, v in _RULES.items())} FROM s),
told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS MATERIALIZED (
  SELECT f.*, good, xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 5 >= 2 AS held FROM f JOIN told USING (doc_id) WHERE NOT base_failed),
cells AS ({" UNION ALL ".join(f"SELECT id, g, held, good, '{k}' AS rule, {k} AS bin FROM known" for k in _RULES)}),
counts AS (SELECT g, rule, bin, count(*) AS n, count(*) FILTER (NOT good) AS bad FROM cells WHERE NOT held AND bin > 0 GROUP BY ALL),
shares AS (SELECT g, rule, bin, (sum(bad) OVER w + 1.0::DOUBLE) / (sum(n) OVER w + 2.0::DOUBLE) AS share FROM counts WINDOW w AS (PARTITION BY g, rule ORDER BY bin DESC)),
best AS (SELECT g, rule, bin, max(share) OVER (PARTITION BY g, rule ORDER BY bin) AS share FROM shares),
steps AS MATERIALIZED (SELECT g, rule, bin, row_number() OVER (PARTITION BY g ORDER BY share DESC, rule, bin DESC) AS step FROM best WHERE share >= 0.5),
caught AS (SELECT c.g, c.id, min(step) AS step FROM cells c JOIN steps p ON c.g = p.g AND c.rule = p.rule AND p.bin <= c.bin WHERE held AND good GROUP BY ALL),
size AS (SELECT g, count(*) AS n, count(*) OVER () AS strata FROM known WHERE held AND good GROUP BY g),
terms AS (SELECT g, n, strata, r, sum(exp(lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1) + r * ln(0.05) + (n - r) * ln(0.95))) OVER (PARTITION BY g ORDER BY r) AS tail FROM (SELECT *, unnest(range(0, n)) AS r FROM size)),
most AS (SELECT g, max(r) AS most FROM terms WHERE tail <= 0.05 / strata GROUP BY g),
allowed AS (SELECT s.g, s.step, (SELECT count(*) FROM caught c WHERE c.g = s.g AND c.step <= s.step) AS false_ FROM steps s),
last AS (SELECT a.g, max(step) AS last FROM allowed a JOIN most USING (g) WHERE false_ <= most GROUP BY a.g),
cuts AS (SELECT s.g, {", ".join(f"min(bin) FILTER (rule = '{k}') AS cut_{k}" for k in _RULES)} FROM steps s JOIN last USING (g) WHERE step <= last GROUP BY s.g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({k} >= cut_{k}, false)" for k in _RULES)}) AS kept
FROM f LEFT JOIN cuts USING (g)
"""
