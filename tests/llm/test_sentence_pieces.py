import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece

from wardlog.llm import sentence_pieces
from wardlog.llm.queries import QUERIES
from wardlog.llm.sentence_pieces import decode_ids, encode_texts, piece_model

PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(rng):
    parts = ["a", " ", "  ", "▁", "é", "日", "\n", "\x00", "́", "🙂", "　", "the", "ing", "tion", "-", "--", "=", "\t", "th",
             " " * 9, " " * 33, "<s>", "<0x41>", "\r\n", "﻿", "１"]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "e=-/*t ", "0123456789", "ab", "аеоин "]
    yield from ("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000))
    for letters in alphabets:
        yield from ("".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(500))


def test_ids_and_texts_are_the_library_s(library):
    texts, model = list(odd_texts(random.Random(4))), piece_model(PATH)
    ids = list(model.encode(texts))
    assert len(ids) == len(texts)
    for text, own, wanted in zip(texts, ids, library.encode(texts)):
        assert own.tolist() == wanted, text
        assert model.decode(own) == library.decode(wanted), text


def test_blocks_change_nothing(library, monkeypatch):
    rng = random.Random(9)
    texts = ["word " * rng.randint(0, 60) + " " * rng.randint(0, 40) + "end" * rng.randint(0, 9) for _ in range(60)] + [""] * 3
    monkeypatch.setattr(sentence_pieces, "BLOCK_CHARS", 40)
    model = piece_model(PATH)
    monkeypatch.setattr(model, "split", lambda text, size=40: type(model).split(model, text, size))
    assert [x.tolist() for x in model.encode(texts)] == library.encode(texts)


def test_any_ids_are_decoded_as_by_the_library(library):
    rng, model = random.Random(6), piece_model(PATH)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3), 3 + 0xE4, 3 + 0xBD, 3 + 0xA0])
               for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


@pytest.mark.parametrize("text", [" " * 50_000, "a" * 20_000, "abc" * 7_000, "x y" * 20_000, "-=" * 9_000, "日本" * 9_000])
def test_very_long_words(library, text):
    assert next(piece_model(PATH).encode([text])).tolist() == library.encode(text)


def test_columns(spark):
    rows = [(1, None, "x", 5), (None, "", "y", 6), (1, "Hello  world", "z", 7), (1, "Hello  world", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, _ids int")
    out = decode_ids(encode_texts(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "_ids", "ids", "decoded"]
    assert sorted((len(r.ids), r.decoded, r._ids) for r in out.collect()) == [(0, "", 5), (0, "", 6), (3, "Hello  world", 7), (3, "Hello  world", 7)]
    nothing = decode_ids(spark.createDataFrame([(None,), ([None, 264],)], "ids array<int>"), PATH)
    assert [r.decoded for r in nothing.collect()] == ["", "a"]
    assert decode_ids(encode_texts(df.limit(0), PATH), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = QUERIES["op11_sentencepiece_rounds"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
