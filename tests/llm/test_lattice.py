import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewire.llm import lattice

PATH = public_tokenizers.path(lattice.MODEL)


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(PATH)


def segmentations(pieces, text):
    """Every way to cut a text into pieces, or a character that is none into bytes."""
    if not text:
        yield []
        return
    known = {t: i for i, t in enumerate(pieces.texts)}
    for n in range(1, min(len(text), pieces.longest) + 1):
        head = text[:n]
        if head in known:
            for rest in segmentations(pieces, text[n:]):
                yield [known[head], *rest]
        elif n == 1:
            for rest in segmentations(pieces, text[1:]):
                yield [*(pieces.size - 256 + b for b in head.encode()), *rest]


WORDS = ["", "a", "the", "house", "ing", "é", "日𠮷", "x\x00y", "▁▁a", "aaaa", "zq!", "🙂b"]


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    weights = np.log(rng.random((pieces.size, 3)))
    laid = pieces.lay_out(WORDS)
    found = laid.forward(laid.weights(weights))[laid.last]
    for word, sums in zip(WORDS, found):
        every = [np.exp(weights[s].sum(axis=0)) for s in segmentations(pieces, lattice.BEGIN + word)]
        assert np.exp(sums) == pytest.approx(sum(every), rel=1e-9), word


def test_expected_uses(pieces):
    laid = pieces.lay_out(WORDS)
    weights = laid.weights(pieces.start[:, None])
    uses = [Counter() for _ in WORDS]
    for word, piece, use in laid.expected(weights, laid.forward(weights)):
        for w, p, u in zip(word.tolist(), piece.tolist(), use.tolist()):
            uses[w][p] += u
    for word, got in zip(WORDS, uses):
        ways = list(segmentations(pieces, lattice.BEGIN + word))
        each = np.exp([pieces.start[s].sum() for s in ways])
        want = Counter()
        for s, p in zip(ways, each / each.sum()):
            for piece in s:
                want[piece] += p
        for piece in set(want) | set(got):
            if piece < pieces.size - 256:
                assert got[piece] == pytest.approx(want[piece], abs=1e-9)


def test_long_words(pieces):
    laid = pieces.lay_out(["x" * 3000, "日" * 500])
    assert np.isfinite(laid.forward(laid.weights(pieces.start[:, None]))).all()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def check_base(found, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if i is not None and not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)
    assert len(got) == len(want)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(7)
    parts = {"aa": "ka to mi ru ne so".split(), "bb": "sch ein ung cht der zu".split()}

    def text(lang):
        return " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40))

    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(list(parts), k=400))]
    found = lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    check_base(found, [r[:2] for r in rows])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_language_has_a_model(spark):
    """Nine languages of one word each: a text's share and words are those of its own language."""
    words = [f"{c}{c}a" for c in "bcdfghjkl"]
    rows = [(i, f"{words[i % 9]} {words[i % 9]}", f"lang{i % 9}") for i in range(630)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = Counter(i % 9 for i in range(630) if zlib.crc32(str(i).encode()) % 7 != 2)
    for r in lattice.score_documents(docs, PATH).collect():
        share = size[r.doc_id % 9] / sum(size.values())
        assert r.score == pytest.approx(math.log10(share * (2 / 3) ** 2 / 3), abs=0.03)


def test_probabilities_of_words_add_up(spark):
    """The model of one-word texts over a closed set of words stays below one."""
    words = ["a", "b", "ab", "ba", "c"]
    rows = [(i, words[i % 5]) for i in range(100)] + [(1000 + k, w) for k, w in enumerate(words)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    found = {r.doc_id: r.score for r in lattice.score_documents(docs, PATH).collect()}
    assert 0.1 < sum(10 ** found[1000 + k] for k in range(5)) < 1


def test_odd_documents(odd_documents, no_documents):
    found = lattice.score_documents(odd_documents, PATH)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check_base(found.collect(), [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])
    assert lattice.score_documents(no_documents, PATH).count() == 0


def test_nothing_to_learn_from(odd_documents):
    from pyspark.sql import functions as F

    docs = odd_documents.withColumn("doc_id", F.lit(None).cast("long"))
    check_base(lattice.score_documents(docs, PATH).collect(), [(None, r.text) for r in docs.select("text").collect()])


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_base(REGISTRY["op5_lm_score"](spark, folder).collect(), rows)
