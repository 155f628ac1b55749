"""The five stages over the smallest tables and over odd rows."""

import os

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from rateforge.llm import fm_index

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def test_stages_and_registration(spark):
    names = entry_point.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "sentencepiece"]


def test_pipeline_on_given_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(left)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert fm_index.hits(out, bench).where("n_hit > 0").count() == 0
        if name in ("decontamination", "sentencepiece"):
            assert set(ids) == set(left)
        left = dict.fromkeys(ids)
        docs = out
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality")).select("doc_id").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_stages_on_odd_and_empty_rows(spark, odd, empty, tmp_path):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).count() <= odd.count()
    assert corpus_pipeline.STAGES[3][1](spark, empty, SF).columns == odd.columns
    assert corpus_pipeline.STAGES[2][1](spark, empty, SF).count() == 0
