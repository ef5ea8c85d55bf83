"""The pipeline stage by stage, and registered queries against their SQL."""
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import decontaminate, simhash
from tracewell.llm.registry import ORACLES, QUERIES
from tracewell.sources.tables import TABLES


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, before, sf_dir))
        assert docs.columns == columns
        assert 0 < docs.count() <= before.count()
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert simhash.near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).count() == 0
        if name == "decontamination":
            assert decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        before = docs
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() == corpus_pipeline.run(spark, sf_dir).count()
    assert last.filter("NOT restored").count() == 0


def test_stages_on_awkward_rows(spark, sf_dir, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, edge_docs, sf_dir)
        assert kept.columns == edge_docs.columns
        assert kept.count() > 0 or name == "quality_rules"  # the words there are half digits, so none need be good
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, edge_docs, sf_dir).filter("NOT restored").count() == 0


def test_rejected_documents_are_bad(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1").join(docs.filter(F.size(F.split("text", " ")) >= 60), "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()
    assert labels.filter("quality = 0").join(kept, "doc_id").count() <= 1


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf_dir):
    df = QUERIES[key](spark, sf_dir)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    if key not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    result = con.execute(ORACLES[key])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
