"""A training-corpus pipeline over ``documents``: each stage calls one operator and hands whole rows on.

Every stage but the last returns the columns of ``documents``; its result is
written as Parquet and read again before the next, so that a lost executor
never costs more than the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm import line_dedup, mixing, quality, sentencepiece_stream, simhash_dedup
from tablemove.llm.common import materialise
from tablemove.session import ensure_checkpoint_dir

#: Token shares that the mix aims at. The total is set so that clean text keeps what it has;
#: rates end at 1, so documents are thinned out, never repeated.
MIX = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}
#: Stretches that an encoding task remembers, twice, until it ends: Python workers live on into the jobs that follow and should not hold them there.
REMEMBERED = 43_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking does not reject."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, short ones included, that occur earlier in the corpus; ``n_chars`` follows the new text."""
    done = line_dedup.dedup_lines(spark, docs, short_exact=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed)
    return done.select(*docs.columns)


def simhash_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4-word shingles, at most 4 differing bits)."""
    return simhash_dedup.keep_one(spark, docs, shingle=4, distance=4)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring expected domain tokens to ``MIX``."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(spark, docs, labels, MIX, total="clean", most=1.0)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    coded = sentencepiece_stream.encode(spark, docs.select("doc_id", "lang", "source", "text"), memory=REMEMBERED)
    coded = materialise(spark, coded, "pipeline-ids")  # in one job a core would run two Python workers at a time, each with its own memory of ids
    back = sentencepiece_stream.decode(spark, coded, text="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_deduplication),
    ("mixing", mixing_to_targets),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL can't express the classifiers nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
