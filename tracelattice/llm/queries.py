"""The registered query of every text operator: (spark, folder of parquet tables) -> DataFrame, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.llm import alignment, bpe, decontam, digest, extract, langid, lines, mixing, ngrams, pii, simhash, suffix, variants
from tracelattice.llm.common import id_remainder, shared_dir


def prepared(spark: SparkSession) -> None:
    """Small batches to Python, as texts may be long; the checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    shared_dir(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.find_pii(docs, *pii.fit_redactor(docs))
    counts = [F.col(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("plain", 256).alias("base_sha256"), "spans")


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = ngrams.score_documents(table(spark, folder, "documents"))
    held_out = F.coalesce(id_remainder(5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix.dedup_substrings(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract.extract_pages(pages, extract.fit_weights(pages))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated_spans(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    done = digest.fingerprint_documents(table(spark, folder, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op8_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.array_join("shard_taken", ",").alias("shard_taken"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    said = langid.identify(docs.select("doc_id", "text"), langid.fit_language_model(docs))
    return said.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def vocabulary_path(name: str) -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    paths = (vocabulary_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    done = alignment.align_documents(table(spark, folder, "documents"), *paths, digests=True)
    return done.withColumnRenamed("groups", "groups_sha256")


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    done = variants.spelling_variants(table(spark, folder, "documents"))
    return done.select("word", "form", "root", "n", "n_near", "form_n")


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.encode_documents(table(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return done.select("doc_id", "n_tokens", *digests)


QUERIES = {
    fn.__name__: fn
    for fn in (op1_pii, op2_lm_score, op3_suffix_dedup, op4_html_text, op5_decontaminate, op6_fingerprint, op7_simhash, op8_mix, op9_line_dedup, op10_language, op11_align_tokens, op12_variants, op13_bpe)
}

ORACLE = {
    # Seats here come from ranking all quotients, blocks from one row per block.
    "op8_mix": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k1, md5(coalesce(text, '')) AS k2
  FROM documents),
src AS (
  SELECT source, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
all_src AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS goal, greatest(1, least(256, min(source_size) FILTER (source_size > 0) // 64))::BIGINT AS block FROM src),
rates AS (
  SELECT a.cap / a.weight AS edge, a.idx,
         ((SELECT goal FROM all_src) - coalesce(sum(b.cap) FILTER ((b.cap / b.weight, b.idx) < (a.cap / a.weight, a.idx)), 0))
         / sum(b.weight) FILTER ((b.cap / b.weight, b.idx) >= (a.cap / a.weight, a.idx)) AS rate
  FROM src a, src b GROUP BY ALL),
rate AS (SELECT rate FROM rates WHERE rate <= edge ORDER BY edge, idx LIMIT 1),
plan AS (SELECT source, idx, source_size, least(cap, (SELECT rate FROM rate) * weight) AS target, goal, block, source_size // block AS full_blocks
         FROM src, all_src),
quotients AS (
  SELECT idx, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, idx) AS turn
  FROM (SELECT *, unnest(range(0, ceil(target / block)::BIGINT + (SELECT count(*) FROM src))) AS k FROM plan)),
shards AS (
  SELECT s AS shard, idx, count(turn) FILTER (turn <= (round(goal / block)::BIGINT * s) // 8) AS seats
  FROM quotients, all_src, range(1, 9) h(s) GROUP BY s, idx),
per AS (
  SELECT plan.*, least(coalesce(seats, 0), 2 * full_blocks) AS quota,
         ('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8))::BIGINT AS phase
  FROM plan LEFT JOIN (SELECT idx, seats FROM shards WHERE shard = 8) USING (idx)),
spread AS (
  SELECT idx, j, block, full_blocks, quota // full_blocks AS passes,
         (j * (quota % full_blocks) + phase % full_blocks) // full_blocks AS before,
         ((j + 1) * (quota % full_blocks) + phase % full_blocks) // full_blocks AS upto
  FROM (SELECT *, unnest(range(0, full_blocks)) AS j FROM per WHERE full_blocks > 0)),
picks AS (
  SELECT idx, j, block, full_blocks, unnest(range(0, passes)) * full_blocks + j AS t FROM spread
  UNION ALL SELECT idx, j, block, full_blocks, passes * full_blocks + before FROM spread WHERE upto > before),
blocks AS (
  SELECT idx, j, block, shard, count(*) AS copies
  FROM (SELECT *, (SELECT count(*) FROM shards WHERE shards.idx = picks.idx AND least(seats, 2 * full_blocks) <= t) AS shard FROM picks) GROUP BY ALL),
places AS (
  SELECT docs.doc_id, docs.source, size, source_size, target, idx, k1, k2, row_number() OVER () AS r,
         (sum(size) OVER (PARTITION BY idx ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS lo
  FROM docs JOIN per ON docs.source IS NOT DISTINCT FROM per.source),
took AS (
  SELECT r, shard, sum(copies * greatest(0, least(lo + size, (j + 1) * block) - greatest(lo, j * block))) AS taken
  FROM places JOIN blocks ON places.idx = blocks.idx AND j >= lo // block AND j <= (lo + size) // block GROUP BY r, shard),
listed AS (SELECT r, sum(taken)::BIGINT AS taken, list(coalesce(taken, 0)::BIGINT::VARCHAR ORDER BY shard) AS by_shard
  FROM (SELECT places.r, s AS shard, taken FROM places CROSS JOIN range(0, 8) h(s) LEFT JOIN took ON took.r = places.r AND took.shard = s) GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, array_to_string(by_shard, ',') AS shard_taken
FROM places JOIN listed USING (r)
""",
}
