import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliolens.llm import language
from foliolens.llm.common import crc32_mod

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == before.columns
        ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
        if name == "near_duplicates":
            assert len(set(ids(docs))) == len(ids(docs)) < len(ids(before))
        if name in ("personal_data", "mixing_sources", "packing"):
            assert set(ids(docs)) == set(ids(before))
    assert docs.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_other_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["La vita è bella e il sole splende sopra la città oggi", "xqzv kjwq zzxq wrtpsdf ghjklm bcvxz", "zx9q kq", "这是 中文 文本", "Всем привет мир"]
    given = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, given, SF).collect()}
    known = language.predict(docs, language.fit(docs, crc32_mod("doc_id", 3) != 1)).where(F.col("score") >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    assert kept == {r["doc_id"] for r in known.collect()} and len(kept) > 0.99 * docs.count()


def test_edges_in_every_stage(spark, docs, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    for given in (docs.select(columns), empty.select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, "").cache()
            given.count()


def test_registration():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
