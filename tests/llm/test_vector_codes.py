import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from wardlog.llm import vector_codes
from wardlog.llm.queries import QUERIES
from wardlog.llm.vector_codes import compress, limit_of, nearest


def plain_nearest(part, book):
    errors = ((np.array(book) - np.array(part)) ** 2).sum(1).tolist()
    return errors.index(min(errors)), min(errors)


@pytest.mark.parametrize("few", [0, 1, 32])
@pytest.mark.parametrize("largest", [1, 3, 2000, 10 ** 8])
def test_trie_finds_the_nearest(monkeypatch, few, largest):
    monkeypatch.setattr(vector_codes, "FEW_PARTS", few)
    rng = np.random.default_rng(few)
    for n, width, entries in ((0, 3, 4), (1, 3, 1), (40, 1, 5), (300, 4, 37), (120, 16, 9)):
        parts = np.unique(rng.integers(-largest, largest + 1, (n, width)), axis=0)
        book = rng.integers(-largest, largest + 1, (entries, width))
        code, error = nearest(parts, book)
        assert list(zip(code, error)) == [plain_nearest(p, book) for p in parts]


def plain(table, entries=256, rounds=4):
    """{vec_id: (code, error, label_error, digest)} of rows (vec_id, vector, label), ids being unique."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in table
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 4
    cut = lambda v, k: v[k * width:(k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(4)]

    def assigned():
        arrays = [np.array(b) for b in books]
        return [[plain_nearest(cut(v, k), arrays[k]) for k in range(4)] for _, v, _ in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v, _), found in zip(kept, assigned()):
            for k in range(4):
                members[k, found[k][0]].append(cut(v, k))
        for (k, e), parts in members.items():
            books[k][e] = [sum(xs) // len(parts) for xs in zip(*parts)]
    found, errors = assigned(), defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(e for _, e in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{c:02x}" for c, _ in f), sum(e for _, e in f), errors[label], digest)
            for (i, _, label), f in zip(kept, found)}


def as_plain(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


@pytest.fixture
def query(spark, tmp_path):
    def run(rows, name="a", kind="array<float>", more=""):
        df = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, label int{more}")
        df.repartition(5).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return QUERIES["op13_trie_codes"](spark, f"{tmp_path}/{name}")
    return run


def test_query_is_the_plain_version(query):
    rng = random.Random(3)
    single = lambda x: float(np.float32(x))
    rows = [(i, [single(rng.choice([rng.gauss(0, .1), 0.25, -0.5])) for _ in range(8)], rng.choice([None, 0, 1, 2])) for i in range(900)]
    rows += [(1000 + i, rows[3][1], 5) for i in range(400)]         # copies
    bad = [None, [None] + [0.1] * 7, [math.nan] + [0.1] * 7, [0.1] * 7 + [math.inf], [-math.inf] * 8]
    rows += [(-10 + i, v, 7) for i, v in enumerate(bad)]
    assert as_plain(query([(*r, "x") for r in rows], more=", code string")) == plain(rows)


def test_table_of_the_driver(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert as_plain(QUERIES["op13_trie_codes"](spark, folder)) == plain(rows)


def test_edges(query):
    few = [(5, [0.5] * 4, None), (4, [-0.5] * 4, 1), (9, [0.5] * 4, None)]
    assert as_plain(query(few, "few")) == plain(few)
    assert query([(1, None, 1)], "none").count() == 0
    assert query([], "empty").count() == 0
    mixed = query([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1), (3, [0.5] * 3, 1), (None, [0.5] * 4, 1), (1, [0.5] * 4, 1)], "mixed")
    assert sorted(str(r.vec_id) for r in mixed.collect()) == ["1", "1", "None"]
    flat = query([(1, [], 1), (2, [], 1)], "flat")
    assert {(r.code, r.error) for r in flat.collect()} == {("00000000", 0)}
    huge = [(1, [1e300, -1e300, 0.0, 1.0], 1), (2, [-1e300, 1e300, 0.0, 1.0], 1), (3, [3e5] * 4, 2)]
    assert [r.error for r in query(huge, "huge", "array<double>").collect()] == [0, 0, 0]
    assert 4 * 4 * limit_of(4) ** 2 < 2 ** 63


def test_codes_refer_to_the_codebooks(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows, books = compress(vectors, parts=8, entries=16, rounds=2)
    originals = {r.vec_id: np.floor(np.array(r.embedding, float) * 1024) for r in vectors.collect()}
    for r in rows.collect():
        near = np.concatenate([books[k, c] for k, c in enumerate(r.code)])
        assert ((near - originals[r.vec_id]) ** 2).sum() == sum(r.errors)
