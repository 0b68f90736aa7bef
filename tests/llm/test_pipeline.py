"""The pipeline on the smallest tables, stage by stage, and its registration."""

import corpus_pipeline
import pytest
from oracle_harness import compare, duck
from pyspark.sql import functions as F

import __spark_entry__


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == [
        "op1_langid", "op2_toxicity", "op3_licenses", "op4_sharding", "op5_chat", "op6_quality", "op7_mixing", "op8_search", "op9_jaccard", "op10_packing",
        "op11_classifier_quality", "op12_periodic_runs", "op13_importance_resampling"]
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, before = docs.columns, docs
    from .test_operators import component_ids, quality_want
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in before.collect()]
        after = stage(spark, before, sf_small).cache()
        if i < 4:
            assert after.columns == columns
        ids = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "quality":
            assert ids == sorted(w[0] for w in quality_want(rows) if w[7])
        if name == "toxicity":
            from skylane.llm import op02_toxicity
            scored = op02_toxicity.toxicity(before, spark.read.parquet(f"{sf_small}/labels.parquet"))
            assert ids == sorted(r["doc_id"] for r in scored.where("predicted = 0").collect())
        if name == "near_duplicates":
            assert ids == sorted({c for _, _, c in component_ids(rows)})
        if name == "mix":
            from skylane.llm import op07_mixing
            taken = op07_mixing.mix(before).where("copies > 0").agg(F.sum("copies")).first()[0]
            assert len(ids) == taken and set(ids) <= {r[0] for r in rows}
        if name == "packing":
            assert set(ids) == {r[0] for r in rows}
        before = after


@pytest.mark.parametrize("name", ["op5_chat", "op6_quality", "op8_search", "op9_jaccard", "op13_importance_resampling"])
def test_oracle(spark, sf_small, name):
    res = compare(__spark_entry__.queries()[name](spark, sf_small), __spark_entry__.oracle_sql()[name], duck(sf_small))
    assert res["names_match"] and res["rows_match"] and res["types_match"] and res["exact"], res
