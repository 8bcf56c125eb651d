"""A corpus pipeline of five operators; each stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.llm.bpe import round_trip_documents
from trialspark.llm.common import held
from trialspark.llm.jaccard import keep_one
from trialspark.llm.language import identify
from trialspark.llm.lines import drop_boilerplate
from trialspark.llm.mixing import take_mix


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator reads, and all others in one, where the operator's new columns cannot touch them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def together(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs again."""
    return df.select(*[c if c in used else F.col(f"__rest.`{c}`") for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, gibberish, ids and texts of an unlearned language go.

    Empty texts have no language and go as well; rows that repeat stay or go together; an empty table stays empty.
    Other columns come through as they are, whatever their names.
    """
    used = ("doc_id", "text", "lang")
    return together(identify(apart(docs, *used)).filter("recognised"), docs, *used)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars follows the text.

    Null and empty texts stay as they are; documents without a source are one site; each repeated row counts as a page;
    an empty table stays empty. Other columns come through as they are, whatever their names.
    """
    used = ("source", "text")
    out = together(drop_boilerplate(apart(docs, *used), F.col("source")), docs, *used)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, similarity 0.8).

    Null and empty texts and rows without doc_id are in no group and stay; rows that repeat a doc_id stay together; an
    empty table stays empty.
    """
    return keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (at most twice).

    Texts without words weigh nothing; documents without a source are a source of their own; repeated rows are
    documents of their own; an empty table stays empty.
    """
    return take_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it again; null and empty texts have none, each row is encoded."""
    import public_tokenizers

    tokenizer = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    out = round_trip_documents(docs.select("doc_id", "source", "text"), keep=False, **tokenizer).withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Language identification cannot be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = held(stage(spark, docs, sf_dir), name)
    return docs
