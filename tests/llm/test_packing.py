import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer
from wardlog.llm.packing import END_ID, LENGTH, encoder, least_cost_cuts, pack_with_public_tokenizer

PATHS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATHS[0])


def test_ids_are_the_library_s(library):
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\n\n", "don't", " we'll", "é", "\t", "12", "!", "?", ".", "<|endoftext|>", "\r\n", "日本",
             "'", "🙂", " ", " x"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids, _ = encoder(*PATHS).encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_cuts_are_of_least_cost():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(5, 12)
        positions, penalties = [0], [0]
        for _ in range(rng.randint(1, 12)):
            positions.append(positions[-1] + rng.randint(1, length))
            penalties.append(rng.choice((0, 2, 5)))
        best = [0]
        for j in range(1, len(positions)):
            best.append(min(best[i] + length - (positions[j] - positions[i]) + penalties[j]
                            for i in range(j) if positions[j] - positions[i] <= length))
        cuts = least_cost_cuts(positions, penalties, length)
        got = sum(length - (positions[b] - positions[a]) + penalties[b] for a, b in zip(cuts, cuts[1:]))
        assert got == best[-1] and cuts[0] == 0 and cuts[-1] == len(positions) - 1


def check(rows, texts, library, least_full):
    """Every id lies in one piece, sequences are gapless and short enough, checksums agree."""
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, END_ID] for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, total in [*((pieces[d], len(ids[d])) for d in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= LENGTH
    assert sum(map(len, ids.values())) >= least_full * LENGTH * len(sequences)


def test_documents_come_back(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(pack_with_public_tokenizer(docs).collect(), texts, library, 0.97)


def test_edges(spark, library):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "no end of sentence " * 900, 5: "<|endoftext|> here."}
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id bigint, text string, length string")
    check(pack_with_public_tokenizer(df.coalesce(1)).collect(), texts, library, 0.9)
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id bigint, text string").coalesce(1)
    assert [(r.start, r.offset) for r in pack_with_public_tokenizer(same).collect()] == [(0, 0), (0, 3), (0, 6)]
    assert pack_with_public_tokenizer(df.limit(0)).count() == 0
