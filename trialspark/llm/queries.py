"""The training-data operators bound to the given tables, with check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.llm.bpe import round_trip_documents
from trialspark.llm.fixity import FIXITY_SQL, audit, replicas
from trialspark.llm.jaccard import jaccard_components
from trialspark.llm.language import identify, is_held_out
from trialspark.llm.lines import LINES_SQL, drop_boilerplate
from trialspark.llm.mixing import MIX_SQL, mix
from trialspark.llm.neardup import near_duplicates
from trialspark.llm.negatives import mine
from trialspark.llm.repair import repair_report
from trialspark.llm.secrets import known_label, scan
from trialspark.llm.substrings import remove_repeats
from trialspark.llm.tokenfile import tokens_on_disk
from trialspark.llm.topk import top_k


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    return audit(*replicas(_table(spark, folder, "pages")))


def _tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = round_trip_documents(_table(spark, folder, "documents").select("doc_id", "text"), **_tokenizer())
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(_table(spark, folder, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Labels: findings of documents outside the held-out third, where their format is known (see known_label)."""
    found = scan(_table(spark, folder, "documents"), F.when(~is_held_out(), known_label()))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "is_secret")


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"), words=4, percent=85)


def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "embeddings"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents"))


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), lambda key: key % 50 == 0)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, F.col("source")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(_table(spark, folder, "conversations"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = tokens_on_disk(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


TOP_K_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

NEAR_DUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.a GROUP BY r.a
"""


HARD_NEGATIVE_SQL = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_warc_fixity, op2_byte_bpe, op3_language_id, op4_secret_scan, op5_ngram_jaccard_join, op6_embedding_near_dedup,
        op7_substring_dedup, op8_source_mix, op9_exact_top_k, op10_line_dedup, op11_hard_negatives, op12_conversation_repair, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": FIXITY_SQL, "op6_embedding_near_dedup": NEAR_DUP_SQL, "op8_source_mix": MIX_SQL, "op9_exact_top_k": TOP_K_SQL, "op10_line_dedup": LINES_SQL,
            "op11_hard_negatives": HARD_NEGATIVE_SQL}
