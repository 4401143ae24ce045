"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import benchmark_tiling, embedding_dedup, hilbert_shards, html_consensus, language_id, license_scan, ngram_join, sentencepiece_gumbel, token_counts, toxicity
from gneiss.llm.common import id_remainder


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; GNEISS_TOKENIZERS names another folder that has it."""
    folder = os.environ.get("GNEISS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit(language_id.training_fold(docs))
    return language_id.predict(docs, profiles).withColumn("held_out", id_remainder("doc_id", 4) == 2)


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.score(docs, model).withColumn("held_out", id_remainder("doc_id", 3) == 1)


def op6_sentencepiece_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_gumbel.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_tiling.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_hilbert_shards, op2_license_scan, op3_ngram_jaccard_join, op4_language_id, op5_toxicity_neighbours,
            op6_sentencepiece_gumbel, op7_token_counts, op8_benchmark_tiling, op9_embedding_near_dedup, op10_html_consensus,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_hilbert_shards": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL}


def _hilbert_sql(n: int = 4, bits: int = 4) -> str:
    """The Hilbert index as a chain of selects over x0..x3 of ``binned``."""
    cte, prev, k = [], "binned", 0
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            new0 = f"CASE WHEN (x{i} & {q}) <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, xor(x0, x{i}) & {q - 1}) END"
            newi = f"CASE WHEN (x{i} & {q}) <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {q - 1}) END"
            sets = [f"{new0} AS x0"] + [f"{newi if j == i else f'x{j}'} AS x{j}" for j in range(1, n)]
            cte.append(f"s{k} AS (SELECT doc_id, size, crc, mixed, {', '.join(sets)} FROM {prev})")
            prev, k = f"s{k}", k + 1
    gray = []
    for i in range(n):
        e = "x0"
        for j in range(1, i + 1):
            e = f"xor({e}, x{j})"
        gray.append(f"{e} AS g{i}")
    cte.append(f"gray AS (SELECT doc_id, size, crc, mixed, {', '.join(gray)} FROM {prev})")
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN (g{n - 1} & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    cte.append(f"flip AS (SELECT *, {flip} AS t FROM gray)")
    index = " + ".join(f"(((xor(g{i}, t) >> {b}) & 1)::BIGINT << {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    cte.append(f"curved AS (SELECT doc_id, size, crc, mixed, {index} AS curve FROM flip)")
    return ",\n".join(cte)


_CRC_STEP = "c"
for _ in range(8):
    _CRC_STEP = f"list_transform([{_CRC_STEP}], lambda v: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
OP1_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, {_CRC_STEP} AS c FROM (SELECT i, i::BIGINT AS c FROM range(256) r(i)))
), keyed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc,
    ((doc_id % 2147483647 + 2147483647) % 2147483647) * 48271 % 2147483647 AS mixed,
    ('0x' || rpad(substr(hex(encode(lang)), 1, 12), 12, '0'))::BIGINT AS klang,
    ('0x' || rpad(substr(hex(encode(source)), 1, 12), 12, '0'))::BIGINT AS ksource, n_chars
  FROM documents, crc_table
), ends AS (
  SELECT min(klang) AS l0, max(klang) AS l1, min(ksource) AS s0, max(ksource) AS s1, min(doc_id) AS d0, max(doc_id) AS d1 FROM keyed
), binned AS (
  SELECT doc_id, size, crc, mixed,
    coalesce(least(floor((klang::DOUBLE - l0::DOUBLE) / (l1::DOUBLE - l0::DOUBLE + 1.0::DOUBLE) * 16)::INT, 15), 0) AS x0,
    coalesce(least(floor((ksource::DOUBLE - s0::DOUBLE) / (s1::DOUBLE - s0::DOUBLE + 1.0::DOUBLE) * 16)::INT, 15), 0) AS x1,
    CASE WHEN n_chars > 0 THEN least(length(bin(n_chars)), 15)::INT ELSE 0 END AS x2,
    coalesce(least(floor((doc_id::DOUBLE - d0::DOUBLE) / (d1::DOUBLE - d0::DOUBLE + 1.0::DOUBLE) * 16)::INT, 15), 0) AS x3
  FROM keyed, ends
), {_hilbert_sql()}, celled AS (
  SELECT *, coalesce(mixed % ((count(*) OVER (PARTITION BY curve) + 4095) // 4096), 0) AS sub FROM curved
), placed AS (
  SELECT *, row_number() OVER (ORDER BY curve, sub, doc_id NULLS FIRST, crc, size) - 1 AS place, count(*) OVER () AS n FROM celled
), cut AS (SELECT *, (place * 16 // n)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard, (place - (shard * n + 15) // 16)::BIGINT AS slot,
  NULL::INT AS grown_shard, curve
FROM cut
"""

OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, generate_series(1, greatest(len(w) - 4, 1)) g(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
