"""Registered queries next to their SQL, and the pipeline next to its stages' plain meaning."""

import compare
import plain
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from wardlog.llm import queries
from wardlog.llm.quality_classifier import classify
from wardlog.llm.quality_rules import judge

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    status, rows, _, note = compare.check(spark, con, FOLDER, name)
    assert status == "ok" and rows > 0, note


def test_every_operator_has_one_query():
    names = [n for n in spark_entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in spark_entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in judge(docs).collect() if r.kept} & {
        r.doc_id for r in classify(docs, labels).collect() if r.predicted == 1}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    one = {d for d, c in plain.components(texts).items() if d == c}
    wanted = [r.text for r in items.collect()]
    clean = {d for d in one if not any(plain.holds_whole(texts[d], w) for w in wanted)}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == clean and clean
