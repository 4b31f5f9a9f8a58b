"""One query per operator, over whole tables, and the SQL that states its result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm import (
    chat, document_fingerprints, embedding_dedup, exact_dedup, html_extract, line_dedup, mixing, quality, sentencepiece_stream,
    simhash_dedup, token_alignment, vector_codes, warc,
)
from tablemove.session import ensure_checkpoint_dir, scratch_path

#: Shares of tokens that op10 aims at.
MIX = {"clean": 0.7, "junk": 0.2, "toxic": 0.1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(spark, docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_stream.encode(spark, docs)
    back = sentencepiece_stream.decode(spark, coded, text="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(spark, _table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark, _table(spark, sf_dir, "conversations"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = scratch_path(spark, "llm", "warc")
    warc.write_archives(spark, pages, path)
    return warc.resolve(spark, warc.read_pages(spark, path)).drop("url", "problem")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, _table(spark, sf_dir, "documents"), short_exact=True).select("doc_id", "n_lines", "n_dropped", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.assign(spark, docs, mixing.label_domains(_table(spark, sf_dir, "labels")), MIX).drop("draw")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(spark, _table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, _table(spark, sf_dir, "embeddings"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.fingerprints(spark, _table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_quality_classifier, op3_sentencepiece, op4_html_extraction, op5_chat_formatting,
        op6_exact_dedup, op7_simhash_near_dedup, op8_warc, op9_line_dedup, op10_mixing,
        op11_token_alignment, op12_vector_codes, op13_document_fingerprints,
    )
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
