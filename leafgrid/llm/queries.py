"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm.alignment import MEASURES, align_tokenizers
from leafgrid.llm.bpe import encode_texts
from leafgrid.llm.chat import digest_chats, format_chats
from leafgrid.llm.common import read_table, sha256_text
from leafgrid.llm.decontaminate import find_passages
from leafgrid.llm.embedding_dedup import near_vectors
from leafgrid.llm.filter_audit import audit_filters, failure_masks
from leafgrid.llm.language import fit_language, identify_language
from leafgrid.llm.line_dedup import dedup_lines
from leafgrid.llm.mixing import mix_sources, taken_words
from leafgrid.llm.near_dedup import near_duplicates
from leafgrid.llm.neighbours import nearest
from leafgrid.llm.quality import fit_quality, fold, score_quality
from leafgrid.llm.sharding import shard_documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(read_table(spark, sf_dir, "documents"), min_words=5)
    return left.select(
        "doc_id",
        "n_lines",
        "n_deleted",
        F.length("text").cast("long").alias("n_chars"),
        sha256_text(F.col("text")).alias("text_sha256"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", taken_words().alias("taken")
    )


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode and hash: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_texts(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.array_join(F.col("ids").cast("array<string>"), " ")).alias(
            "ids_sha256"
        ),
        sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], convs.schema
    )
    return digest_chats(format_chats(convs.union(probe)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(fold("doc_id", 5) != 0))
    return score_quality(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(fold("doc_id", 3) != 1))
    return identify_language(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def sha256_hex(line: bytes) -> str:
    return hashlib.sha256(line).hexdigest()


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return align_tokenizers(docs, keep=sha256_hex).select(
        "doc_id", *MEASURES, F.col("groups").alias("groups_sha256")
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_text(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(
        failure_masks(
            read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
        )
    )


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_bpe": op4_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_shard_documents": op9_shard_documents,
    "op10_nearest": op10_nearest,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_decontaminate": op12_decontaminate,
    "op13_filter_audit": op13_filter_audit,
}

OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, row_number() OVER () AS row_id FROM documents
), raw AS (
  SELECT doc_id, row_id, unnest(string_split(text, chr(10))) AS s,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM docs
), lines AS (
  SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY row_id ORDER BY place) AS n
  FROM raw WHERE regexp_matches(s, '[^\x20\x09-\x0D]')
), ahead AS (
  SELECT doc_id, row_id, n,
         list(s) OVER f AS fs, list(words) OVER f AS fw,
         list(s) OVER b AS bs, list(words) OVER b AS bw
  FROM lines
  WINDOW f AS (PARTITION BY row_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
         b AS (PARTITION BY row_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
), sized AS (
  SELECT *,
    list_min(list_filter([1,2,3,4,5], lambda k: k <= len(fw) AND list_sum(fw[1:k]) >= 5)) AS fm,
    list_min(list_filter([1,2,3,4,5], lambda k: k <= len(bw) AND list_sum(bw[len(bw)-k+1:len(bw)]) >= 5)) AS bm
  FROM ahead
), runs AS (
  SELECT doc_id, row_id, n AS first, fm AS m, fs[1:fm] AS content FROM sized WHERE fm IS NOT NULL
  UNION
  SELECT doc_id, row_id, n - bm + 1, bm, bs[len(bs)-bm+1:len(bs)] FROM sized WHERE bm IS NOT NULL
), copies AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS turn FROM runs
), gone AS (
  SELECT DISTINCT row_id, unnest(range(first, first + m)) AS n FROM copies WHERE turn > 1
), marked AS (
  SELECT raw.row_id, raw.place, raw.s, gone.n IS NOT NULL AS dropped
  FROM raw LEFT JOIN lines USING (row_id, place)
  LEFT JOIN gone ON gone.row_id = lines.row_id AND gone.n = lines.n
), left_over AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_deleted,
         coalesce(string_agg(s, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text
  FROM marked GROUP BY row_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
       length(l.text)::BIGINT AS n_chars, sha256(l.text) AS text_sha256
FROM docs d LEFT JOIN left_over l USING (row_id)
"""

OP12_SQL = r"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
         array_to_string(ws[k:k + 9], ' ') AS w
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(k) WHERE len(ws) > 0
), docs AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), places AS (
  SELECT row_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(ws) - n + 2)) AS t(k)
), met AS (
  SELECT row_id, k, n, item_id FROM places JOIN windows USING (n, w)
), hit AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT row_id, k, n FROM met), unnest(range(k, k + n)) AS t(p) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS least
  FROM docs
), masks AS (
  SELECT part,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > least, false)::INT AS mask,
         count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM words LEFT JOIN said USING (doc_id) GROUP BY ALL
), bits AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS b(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM bits a, bits b, bits c, bits d, bits e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits.bit,
         (SELECT coalesce(sum(e.bit), 0) FROM bits e WHERE strpos(filter_order[1:step - 1], e.f) > 0)::INT AS gone
  FROM orders, unnest(range(1, 6)) AS t(step), bits WHERE bits.f = filter_order[step]
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & gone > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
