"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (codes, licenses, lines, mixing, quality, rules, shard, simhash, substrings, tokens, topk,
               whitening)
from .common import documents, pick, ship, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a license notice in all documents."""
    return licenses.scan_licenses(documents(spark, sf_dir, "doc_id", "text"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all documents; model of all trusted ones."""
    return quality.classify(documents(spark, sf_dir, "doc_id", "text", "lang"),
                            table(spark, sf_dir, "labels"), order=quality.LONGEST).drop("key")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes (law 'bytes')."""
    d = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shard.assign_shards(d, 16, "size", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, up to 4 bits apart."""
    return simhash.simhash_components(documents(spark, sf_dir, "doc_id", "text"), 4, 4).select(
        "doc_id", "fingerprint", "component_id")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    return tokens.encode_documents(documents(spark, sf_dir, "doc_id", "text"), ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with suffix sums."""
    return tokens.length_histogram(documents(spark, sf_dir, "source", "text"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by Hamming distance of their sign codes, of every
    vector whose id is divisible by 20, among all vectors."""
    e = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    words = topk.words_for(e, "embedding")
    v = e.select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding"), words).alias("code"))
    q = v.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return topk.top_k(v, q, 10)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on all documents, cutoffs certified on all labelled ones."""
    return rules.apply_rules(documents(spark, sf_dir, "doc_id", "text", "lang"),
                             table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1."""
    return mixing.mix_documents(documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", "source", "size", "source_size", "target", "times", "taken")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a document that repeats text of another document."""
    return substrings.repeated_passages(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "kept_doc_id", "kind", "start_word", "n_words")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more have."""
    kept = lines.drop_common_lines(documents(spark, sf_dir, "doc_id", "text"), 10, 1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 4 parts, 256 entries each, 4 rounds."""
    ship(spark)
    coded, books, dims = codes.compress(table(spark, sf_dir, "embeddings"), 4, 256, 4)
    return codes.label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest(books, dims)).alias("codebooks_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 8 largest components of their covariance, whitened."""
    ship(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, md5(text) AS h, string_split(coalesce(text, ''), chr(10)) AS ls
           FROM documents),
l AS (SELECT rid, doc_id, h, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT key, doc_id, h FROM k WHERE length(key) >= 1) x GROUP BY key HAVING count(*) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.rid, k.doc_id"""


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10"""

def _op8_sql() -> str:
    """The rules in SQL: windows and lines as rows, the binomial sums by lgamma."""
    def stat(r):
        a, b = rules.RULES[r][0].removeprefix("try_divide(").removesuffix(")").split(", ")
        return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"

    grid = ", ".join(f"('{r}', {c!r}::DOUBLE)" for r, (_, cuts) in rules.RULES.items() for c in cuts)
    rate = repr(rules.ALLOWED) + "::DOUBLE"
    stats = " UNION ALL ".join(f"SELECT rid, stratum, '{r}' AS rule, {stat(r)} AS x FROM b WHERE NOT base_failed"
                               for r in rules.RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, md5(text) AS h, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3) x),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) x WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM twice) x GROUP BY rid),
dup AS (
  SELECT rid, sum(c - 1) AS n FROM (
    SELECT rid, l, count(*) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) x
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l) y GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, lang, h, CASE WHEN lang IS NULL THEN 'b' ELSE 'a' || lang END AS stratum,
         CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup ON d.rid = dup.rid LEFT JOIN rep ON d.rid = rep.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS ({stats}),
g AS (
  SELECT min(rid) AS rid, stratum, substr(h, 1, 1) < '8' AS design FROM b
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum, h),
h AS (SELECT s.*, g.design FROM s JOIN g ON s.rid = g.rid),
nd AS (SELECT stratum, count(*) AS n FROM g WHERE design GROUP BY stratum),
nt AS (SELECT stratum, count(*) AS n FROM g WHERE NOT design GROUP BY stratum),
grid AS (SELECT * FROM (VALUES {grid}) v(rule, cut)),
above AS (
  SELECT nd.stratum, nd.n, grid.rule, cut, count(h.rid) AS c
  FROM nd CROSS JOIN grid LEFT JOIN h ON h.design AND h.stratum = nd.stratum AND h.rule = grid.rule AND h.x > cut
  GROUP BY nd.stratum, nd.n, grid.rule, cut),
path AS (
  SELECT stratum, step, rule, min(cut) AS cut FROM above, (SELECT unnest(range(0, {rules.STEPS + 1})) AS step) i
  WHERE c <= floor(n * step * {rules.STRIDE!r}::DOUBLE + 1e-9::DOUBLE) GROUP BY stratum, step, rule),
fails AS (
  SELECT h.stratum, step, count(DISTINCT rid) AS c FROM h JOIN path ON h.stratum = path.stratum AND h.rule = path.rule
  WHERE NOT design AND x > cut GROUP BY h.stratum, step),
j AS (SELECT stratum, n, unnest(range(0, n + 1)) AS j FROM nt),
cdf AS (
  SELECT stratum, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate})
                      + (n - j) * ln(1 - {rate}))) OVER (PARTITION BY stratum ORDER BY j) AS p FROM j),
k AS (
  SELECT stratum, count(*) FILTER (p <= {rules.MISTAKE!r}::DOUBLE / (SELECT count(DISTINCT stratum) FROM g)) - 1 AS k
  FROM cdf GROUP BY stratum),
steps AS (
  SELECT k.stratum, max(i.step) AS step FROM k JOIN nd ON k.stratum = nd.stratum
  CROSS JOIN (SELECT unnest(range(0, {rules.STEPS + 1})) AS step) i
  LEFT JOIN fails ON k.stratum = fails.stratum AND i.step = fails.step
  WHERE coalesce(c, 0) <= k GROUP BY k.stratum),
cuts AS (SELECT path.* FROM path JOIN steps ON path.stratum = steps.stratum AND path.step = steps.step),
bad AS (SELECT DISTINCT rid FROM s JOIN cuts ON s.stratum = cuts.stratum AND s.rule = cuts.rule WHERE x > cut)
SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad ON b.rid = bad.rid"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', coalesce(md5(text), 'null')) AS digest
  FROM documents),
k AS (
  SELECT *, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS g,
         CAST('0x' || substr(md5('mix-7:' || digest), 1, 15) AS BIGINT) AS key FROM d),
z AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY g),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY g) - 1) % 3 + 1] AS w, 3 * source_size AS cap,
         sum(source_size) OVER () AS everything FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, g) AS pos FROM w),
f AS (
  SELECT *, CAST(CAST(everything - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM o),
u AS (SELECT *, share * w > cap AS above FROM f),
t AS (
  SELECT g, source_size, CASE WHEN above THEN CAST(cap AS DOUBLE)
         ELSE (SELECT arg_min(share, pos) FROM u WHERE NOT above) * w END AS target FROM u),
e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t),
r AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY k.g ORDER BY key, digest, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN e ON k.g = e.g),
x AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN least(3, epochs + CASE WHEN CAST(before AS DOUBLE) + size / CAST(2 AS DOUBLE) <= rest THEN 1 ELSE 0 END)
         ELSE 0 END AS INTEGER) AS times FROM r)
SELECT doc_id, source, size, source_size, target, times, CAST(size * times AS BIGINT) AS taken FROM x"""


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_byte_shards": op3_byte_shards,
        "op4_simhash_components": op4_simhash_components,
        "op5_piece_codec": op5_piece_codec,
        "op6_token_counts": op6_token_counts,
        "op7_hamming_topk": op7_hamming_topk,
        "op8_quality_rules": op8_quality_rules,
        "op9_mix_sources": op9_mix_sources,
        "op10_repeated_passages": op10_repeated_passages,
        "op11_line_dedup": op11_line_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_hamming_topk": OP7_SQL, "op8_quality_rules": _op8_sql(), "op9_mix_sources": OP9_SQL,
            "op11_line_dedup": OP11_SQL}
