import zlib

import plain
import pytest
from wardlog.llm import quality_classifier, quality_rules

TEXTS = ["", None, " \n ", "a b c a b c a b c", "the cat sat on the mat\nthe cat sat on the mat\n\n x # $%",
         "é" * 3000, "w " * 20_000, "a\x0bb\x0cc\rd\te", "a b c d", "x<y>|z&*", "\n\n\n", "| a | b |\n| a | b |"]


def test_counts_agree_with_a_plain_version(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, text in enumerate(TEXTS):
        want = plain.rule_counts(text)
        assert {k: got[i][k] for k in want} == want, text
        assert got[i].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i].base_failed and got[i].kept)


def test_keep_good_keeps_rows_as_they_are(spark):
    good = " ".join(f"the w{i} of v{i}." for i in range(40))
    df = spark.createDataFrame([(1, good, "x"), (None, good, "y"), (1, good, "x"), (2, "short", "x"), (3, None, None)],
                               "doc_id bigint, text string, row string")
    left = quality_rules.keep_good(df)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, df.where(df.text == good).collect()))
    assert quality_rules.keep_good(df.limit(0)).count() == 0 and quality_rules.judge(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    scored = quality_classifier.classify(docs, labels).collect()
    assert len(scored) == docs.count()
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(truth[r.doc_id], r.predicted) for r in scored if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_held_out_labels_and_other_columns_are_no_input(spark, tables):
    docs, labels = tables
    few = docs.where("doc_id < 60")
    bucket = "crc32(cast(doc_id as string)) % 4 = 2"
    turned = labels.selectExpr("doc_id", f"case when {bucket} then 1 - quality else quality end as quality")
    plain_scores = {r.doc_id: r.score for r in quality_classifier.classify(few, labels, docs).collect()}
    other = few.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source", "1 as score")
    for r in quality_classifier.classify(other, turned, docs).collect():
        assert abs(r.score - plain_scores[r.doc_id]) < 1e-9


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a " * 50_000, None), (2, "a " * 50_000, None)],
                                "doc_id bigint, text string, score string")
    rows = quality_classifier.classify(odd, labels, docs).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(odd.limit(0), labels, docs).count() == 0
    blind = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in blind)
    assert quality_classifier.keep_predicted(odd, labels, docs).columns == odd.columns
