import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewire.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    letters = [*"aabbcdest  .,'\n\t\r\x85\xa0\x1c\x1féßªº²½€—…‘’日本ا🙂İſŸẞ 　́ƁǅȺ_-019!@\x00", "'s", "'RE", " the", "<|endoftext|>", "<|startoftext|>", "ing"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(5000)]
    flat, starts = packing.encode(pa.array(texts), PATH)
    assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == [ids_of(library, t)[:-1] for t in texts]
    flat, starts = packing.encode(pa.array([], pa.string()), PATH)
    assert len(flat) == 0 and starts.tolist() == [0]


def test_remembered_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = [f"word{i % 90} again" for i in range(400)]
    found = [packing.encode(pa.array([t]), PATH)[0] for t in texts]
    assert [f.tolist() for f in found] == [ids_of(library, t)[:-1] for t in texts]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_path_through_all_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(found, rows, library):
    whole = {}
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    want = {}
    for i, t in rows:
        ids = ids_of(library, t)
        for k, x in enumerate(ids):
            want.setdefault((i, len(ids)), []).append((k, x))
    got = {k: sorted((s + n, x) for s, ids in v for n, x in enumerate(ids)) for k, v in whole.items()}
    assert got == {k: sorted(v) for k, v in want.items()}
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_pieces_hold_every_id_once(spark, library):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "of", "zebra", "wörld", "x1"], k=rng.choice([0, 3, 500, 5000])))) for i in range(60)]
    rows.append((60, " ".join(["long"] * 40_000)))
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    check(found, rows, library)


def test_odd_documents(odd_documents, no_documents, library):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    found = packing.pack(odd_documents, PATH).collect()
    check(found, rows, library)
    assert packing.pack(no_documents, PATH).count() == 0


def test_query(spark, folder, library):
    from tidewire.llm.queries import REGISTRY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = REGISTRY["op9_packing"](spark, folder).collect()
    for r in found:
        ids = np.array(ids_of(library, texts[r.doc_id]), dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r["length"]].tobytes())
    assert sum(r["length"] for r in found) == sum(len(ids_of(library, t)) for t in texts.values())
