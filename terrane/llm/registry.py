"""The queries of this subpackage and their SQL, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm.tables import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.quality import score_labelled_documents

    return score_labelled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.topk import search_embeddings

    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.substring import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, similarity=(85, 100))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.url_filters import RULES, judge_pages

    return judge_pages(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.media import store_documents, stored_features

    return stored_features(store_documents(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_weighted_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.codebooks import compress_embeddings

    return compress_embeddings(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_sentencepiece_codec, op3_quality_classifier, op4_exact_top_k, op5_substring_dedup, op6_ngram_jaccard_join, op7_url_filters, op8_packing, op9_media_columns, op10_language_id, op11_hash_tree_sharding, op12_tokenizer_alignment, op13_weighted_codebooks, pipeline]
    return {f.__name__: f for f in found}


#: The method's removal written over all windows at once: DuckDB can hold them at the size of the SQL check.
OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS d FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (win) WHERE firsts.d < windows.doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, w, coalesce(g.n, 0) AS n_removed, g.idx
  FROM words LEFT JOIN (SELECT doc_id, count(*) AS n, list(i) AS idx FROM gone GROUP BY doc_id) g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(
  CASE WHEN idx IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(idx, i)) END, ' '), '')) AS kept_sha256
FROM kept
"""

#: Integer inner products of every query with every other row, ranked.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


#: Draws of the two regions, the two racks of the chosen one and its four shards, and of a third region of weight 1; the
#: checksum byte by byte from a table of 256 entries made of the polynomial.
OP11_SQL = r"""
WITH ids AS (
  SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '') || '|' AS k FROM documents
), regions AS (
  SELECT *, ln((CAST('0x' || substr(md5(k || '0'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / 8 AS d0,
    ln((CAST('0x' || substr(md5(k || '1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / 8 AS d1,
    ln((CAST('0x' || substr(md5(k || '2'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / 1 AS d2 FROM ids
), racks AS (
  SELECT *, CASE WHEN d0 >= d1 THEN 0 ELSE 1 END AS region FROM regions
), chosen AS (
  SELECT *, CASE WHEN substr(md5(k || region || '/0'), 1, 13) >= substr(md5(k || region || '/1'), 1, 13) THEN 0 ELSE 1 END AS rack FROM racks
), leaves AS (
  SELECT *, list_transform(range(8 * region + 4 * rack, 8 * region + 4 * rack + 4), lambda s: substr(md5(k || region || '/' || rack || '/' || s), 1, 13)) AS l FROM chosen
), placed AS (
  SELECT doc_id, text, greatest(d0, d1) < d2 AS grows, CAST(8 * region + 4 * rack + list_position(l, list_aggregate(l, 'max')) - 1 AS INTEGER) AS shard FROM leaves
), polynomial AS (
  SELECT list(list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS text_crc32,
  'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot,
  CAST(CASE WHEN grows THEN 16 ELSE shard END AS INTEGER) AS grown_shard
FROM placed, polynomial
"""


_NEAR = "list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ASSIGN = "SELECT vec_id, p.pos, any_value(p.label) AS label, any_value(p.part) AS part, arg_min(k, {d} * 256 + k) AS k, CAST(min({d}) AS BIGINT) AS d FROM p JOIN {b} c ON c.pos = p.pos GROUP BY vec_id, p.pos".replace("{d}", _NEAR)
_MEANS = "SELECT {b}.pos, {b}.k, coalesce(m.part, {b}.part) AS part FROM {b} LEFT JOIN (SELECT pos, k, list(v ORDER BY i) AS part FROM (SELECT pos, k, i, CAST(floor(CAST(sum(part[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM {a}, range(1, 257) r(i) WHERE i <= len(part) GROUP BY ALL) GROUP BY ALL) m USING (pos, k)"
#: All parts of all vectors against the codebooks, two rounds and the last assignment; ids are distinct in the tables.
OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, pos, e[pos * (len(e) // 16) + 1 : (pos + 1) * (len(e) // 16)] AS part FROM v, range(16) r(pos)
), b0 AS (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS k, part FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
), a0 AS ({_ASSIGN.format(b="b0")}), b1 AS ({_MEANS.format(a="a0", b="b0")}),
a1 AS ({_ASSIGN.format(b="b1")}), b2 AS ({_MEANS.format(a="a1", b="b1")}),
a2 AS ({_ASSIGN.format(b="b2")}), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', k), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, k)) FROM b2) AS codebooks_sha256
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op11_hash_tree_sharding": OP11_SQL, "op13_weighted_codebooks": OP13_SQL}
