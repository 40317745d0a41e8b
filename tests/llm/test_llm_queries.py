"""The registered queries against DuckDB, and the pipeline on planted cases."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from carbonsplit.llm import decontamination, labelled, line_dedup, mixing, simhash, toxicity
from carbonsplit.llm.registry import QUERIES, STATEMENTS

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", STATEMENTS)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = QUERIES[name](spark, FOLDER), con.execute(STATEMENTS[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = got.select(columns).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, want.fetchall()))


def test_classifiers_learn_from_their_rows_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    out = {r.doc_id for r in docs.filter(labelled.held_out(3, 1)).collect()}
    learned = labelled.training_rows(docs, marks, "toxic", 3, 1, {1: 100, 0: 100})
    assert {int(text.split()[1]) for text, _ in learned} == set(range(60)) - out
    assert len(labelled.training_rows(docs, marks, "toxic", 3, 1, {1: 5, 0: 7})) == 12


def test_pipeline_is_its_stages_in_order(spark):
    """The run equals the operators applied one after another, each on what its predecessor kept."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    marks, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    rows = docs.toPandas()
    rows = rows[[scores[i] < 0.7 for i in rows.doc_id]]
    frame = spark.createDataFrame(rows)
    cut = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    rows["text"] = [cut[i].text for i in rows.doc_id]
    rows = rows[[cut[i].n_removed == 0 or bool(cut[i].text.strip()) for i in rows.doc_id]]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows)).collect()}
    rows = rows[[groups[i] == i for i in rows.doc_id]]
    hits = {r.doc_id: r.n_hit for r in decontamination.contaminated_words(spark.createDataFrame(rows), items).collect()}
    rows = rows[[hits[i] == 0 for i in rows.doc_id]]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows)).collect()}
    want = sorted((i, t, n) for i, t in zip(rows.doc_id, rows.text, strict=True) for n in range(1, copies[i] + 1))
    got = sorted((r.doc_id, r.text, r.copy) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "text", "copy").collect())
    assert got == want and len(got) > 100
