import random

import plain
from wardlog.llm.components import components
from wardlog.llm.neardup import keep_one_of_each, near_duplicates
from wardlog.llm.shingles import shingle_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed, groups=6, size=9):
    """Groups of near copies at many distances, exact copies, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((8, 60, 200)))]
        for k in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20)) if k else 0):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append("  ".join(base).upper())
    texts += [" ".join([*(word() for _ in range(40)), *shared]) for _ in range(10)]
    texts += ["", None, " \n\t", "one two", "One  TWO", "x" * 100_000, "é è ê ü ö ä", "É è ê ü ö ä"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_agrees_with_all_pairs(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs.items()], SCHEMA)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    want = plain.components(docs)
    assert len(got) == len(docs)
    for d, text in docs.items():
        assert got[d].n_shingles == len(plain.shingles(text))
        assert (got[d].component_id, got[d].kept) == (want[d], want[d] == d), d
    kept = {r.doc_id for r in keep_one_of_each(df).collect()}
    assert kept == {d for d in docs if want[d] == d}


def test_one_large_group_is_linked_through_its_hub_and_past_it(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = {0: " ".join(base)}
    for d in range(1, 160):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 3, 5))):
            copy[rng.randrange(120)] = f"n{rng.random()}"
        docs[d] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == plain.components(docs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "A b c d e f", "x"), (None, "a b c d e f", "x"),
            (None, "other words here", "x"), (None, "other words here", "x"), (7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("7", "7", True), ("7", "7", True),
                   ("None", "1", False), ("None", "None", True), ("None", "None", True)]
    left = keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect() if r.text) == [
        ("1", "a b c d e f"), ("None", "other words here")]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one_of_each(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_shingles_by_hash_are_as_many_as_by_words():
    for text in corpus(3).values():
        assert len(shingle_hashes(text)) == len(plain.shingles(text))
