"""The pipeline's stages on the smallest tables, against what each operator says."""

import sys

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as P
from tablemove.llm import mixing, quality, sentencepiece_stream, simhash_dedup
from tests.llm.helpers import LABELS, SF, docs, good_and_bad


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    now = docs
    for k, (_, stage) in enumerate(P.STAGES):
        before = now.count()
        now = P.materialise(spark, stage(spark, now, SF), "test-stage")
        if k < 4:
            assert now.columns == docs.columns
        if k == 0:
            marked = labels.where("quality = 1").join(docs, "doc_id")
            assert marked.join(now, "doc_id").count() >= 0.95 * marked.count()
            assert labels.where("quality = 0").join(now, "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
        if k == 1:
            assert now.count() == before and now.where(F.char_length("text") != F.col("n_chars")).count() == 0
        if k == 2:
            again = simhash_dedup.near_duplicates(spark, now)
            assert 0 < again.count() < before and again.where("not kept").count() == 0
        if k == 3:
            clean = now.join(labels.where("quality = 1 and toxic = 0"), "doc_id").count()
            assert clean > 0 and now.count() <= before
    assert now.where("not round_trip").count() == 0 and now.where("n_ids <> size(ids)").count() == 0


def test_run_gives_the_last_stage(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "ids", "n_ids"} <= set(got.columns) and got.count() > 0


def test_the_encoder_holds_little_in_each_worker(spark, monkeypatch):
    """Every Python worker of an executor keeps its memory of ids, so the pipeline's is small; its ids are those of op3."""
    asked, encode = [], sentencepiece_stream.encode
    monkeypatch.setattr(sentencepiece_stream, "encode", lambda *a, **k: asked.append(k["memory"]) or encode(*a, **k))
    docs = spark.createDataFrame([(i, "en", "s", f"word{i} and{i % 7} {i * i}") for i in range(300)], "doc_id long, lang string, source string, text string")
    got = P.sentencepiece_encoding(spark, docs, SF)
    assert got.where("not round_trip").count() == 0
    assert sorted(got.select("doc_id", "ids").collect()) == sorted(encode(spark, docs).select("doc_id", "ids").collect())
    codec = sentencepiece_stream.Codec(sentencepiece_stream.Vocabulary.load(sentencepiece_stream.MODEL), asked[0])
    for i in range(5_000):
        codec.encode(f"a{i}b{i * 7919 % 100_003}c{i}")
    each = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in codec.items()) / len(codec)
    assert 2 * asked[0] * each < 25e6


def _plans(monkeypatch, module):
    """Physical plans of what ``module`` writes, by tag."""
    plans, write = {}, module.materialise

    def told(spark, df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(spark, df, tag)

    monkeypatch.setattr(module, "materialise", told)
    return plans


def test_mixing_computes_rates_once(spark, monkeypatch):
    """A second evaluation in the same stage takes a second Python worker for each core."""
    rows, labels = good_and_bad()
    plans = _plans(monkeypatch, mixing)
    table, marked = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    got = mixing.mix(spark, table, mixing.label_domains(marked), P.MIX, total="clean", most=1.0)
    assert 0 < got.count() <= len(rows)
    assert plans["mix-copies"].count("ArrowEvalPython") == 1


def test_quality_starts_no_python_for_its_range_totals(spark, monkeypatch):
    rows, labels = good_and_bad()
    plans = _plans(monkeypatch, quality)
    assert quality.keep_good(spark, docs(spark, rows), spark.createDataFrame(labels, LABELS)).count() > 0
    assert "LocalTableScan" in plans["quality-cuts"] and "ExistingRDD" not in plans["quality-cuts"]


def test_the_pipeline_encoder_leaves_no_memory_in_a_worker(spark, monkeypatch):
    """Python workers outlive a job; what an encoding task remembers would add to the memory of the stages that follow."""
    made, real = [], F.pandas_udf
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: made.append(f) or real(kind)(f))
    monkeypatch.setattr(sentencepiece_stream, "_CODECS", {})
    rows = spark.createDataFrame([(1, "en", "s", "one text")], "doc_id long, lang string, source string, text string")
    P.sentencepiece_encoding(spark, rows, SF)
    sentencepiece_stream.encode(spark, rows)
    piped, plain = (f for f in made if f.__qualname__.startswith("encode."))
    (ids,) = piped(iter([pd.Series(["one text", "another"])]))
    assert not sentencepiece_stream._CODECS
    (same,) = plain(iter([pd.Series(["one text", "another"])]))
    assert len(sentencepiece_stream._CODECS) == 1 and [list(x) for x in ids] == [list(x) for x in same]
