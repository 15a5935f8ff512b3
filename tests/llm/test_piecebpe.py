import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidewire.llm import piecebpe

PATH = public_tokenizers.path(piecebpe.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piecebpe.Encoder(PATH)


def same(encoder, library, text):
    ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
    assert ids == library.encode(text), repr(text[:80])
    assert encoder.decode(ids) == library.decode(ids), repr(text[:80])


def test_texts_of_odd_letters(encoder, library):
    rng = random.Random(3)
    letters = [*"aaabbbcdeeeeinrst  .,'\n\t▁éüß日本中ا🙂𠮷​\x00<>0x41s", "the", " and", "▁▁", "    ", "##", "==", "<s>", "<0x0A>"]
    for _ in range(6000):
        same(encoder, library, "".join(rng.choices(letters, k=rng.randint(0, 30))))


def test_texts_of_pieces(encoder, library):
    rng = random.Random(4)
    pieces = list(encoder.ids)
    for _ in range(3000):
        same(encoder, library, "".join(rng.choices(pieces, k=rng.randint(1, 8))))


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, " " * 777, "ab" * 5000, "=-" * 3000, "\n" * 50, "日" * 2000])
def test_long_runs(encoder, library, text):
    same(encoder, library, text)


def test_long_texts_go_in_blocks(encoder, library, monkeypatch):
    text = "some words, and\nmore  of them " * 400
    monkeypatch.setattr(piecebpe, "AT_ONCE", 100)
    monkeypatch.setattr(piecebpe, "REMEMBERED", 20)
    same(encoder, library, text)


def test_bytes_remembered_are_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(piecebpe, "REMEMBERED", 20_000)
    encoder.forget()
    for i in range(40):
        same(encoder, library, " ".join(f"w{i}x{k}" for k in range(50)) + " " + "ab" * 1000)
        assert encoder.held <= 20_000
        assert sum(len(k) + len(v) for held in (encoder.chunks, encoder.parts) for k, v in held.items()) <= 20_000


def test_ids_of_any_type(spark, library):
    docs = spark.createDataFrame([("a", "one two"), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r.ids for r in piecebpe.encode(docs, PATH).collect()}
    assert got == {"a": library.encode("one two"), None: library.encode("x")}


def test_a_pair_fits_if_merging_gives_it_again(encoder):
    a, b = encoder.ids["▁t"], encoder.ids["he"]
    assert not encoder._fit(a, b) and encoder.merge("▁the") == [encoder.ids["▁the"]]


def test_odd_documents(odd_documents, no_documents, library):
    found = piecebpe.encode(odd_documents, PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    texts = [(r.doc_id, r.text or "") for r in odd_documents.select("doc_id", "text").collect()]
    want = [(i, library.encode(t), library.decode(library.encode(t))) for i, t in texts]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ids, r.decoded)) for r in found.collect())
    assert piecebpe.encode(no_documents, PATH).count() == 0


def test_query(spark, folder, library):
    from tidewire.llm.queries import REGISTRY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = REGISTRY["op2_piece_encoding"](spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
