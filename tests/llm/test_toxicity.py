import itertools
import random
import zlib

import numpy as np
import pytest

from tidewire.llm import toxicity

WORDS = "the house of a river and green day with some light over it again from here".split()
RUDE = ["idiot", "worthless", "scum", "zurgle"]


def documents(rng, n):
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(10, 60))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        yield i, " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def frames(spark):
    rows = list(documents(random.Random(6), 900))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_features():
    learned = {"zurgle": 3.0}
    rude = toxicity.features("YOU are an IDIOT, zurgle! st00pid", learned)
    assert len(rude) == toxicity.FEATURES == len(toxicity.features(None, learned)) == len(toxicity.features("", {}))
    assert rude[1] > 0 and rude[4] > 0 and rude[7] == 3.0 and rude[10] > 0 and rude[12] > 0 and rude[14] > 0 and rude[15] > 0
    assert toxicity.features("st@pid 1d10t id!ot", {})[18] > 0
    assert toxicity.features("i d i o t", {})[19] == 1 and toxicity.features("stuuuupid", {})[19] == 1
    assert all(np.isfinite(toxicity.features("x" * 100_000, {})))


@pytest.mark.parametrize("word", ["hate", "kill", "liar", "pig"])
def test_unambiguous_words_need_no_label(word):
    found = toxicity.features(f"a {word} again and you", {})
    assert found[1] > 0 and found[11] > 0


def test_du_is_a_german_word_of_the_second_person():
    assert min(toxicity.features("du bist ein Idiot und ich gehe", {})[10:13]) > 0
    assert toxicity.features("du Idiot", {})[12] > 0
    assert toxicity.features("le prix du pain et la couleur du jour", {})[10] == 0


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.permutation(7).astype(float), rng.integers(0, 2, 7).astype(float)
        ends, levels = toxicity.isotonic(x, y)
        assert (np.diff(levels[::2]) > 0).all() and (levels[::2] == levels[1::2]).all() and (np.diff(ends) >= 0).all()
        order = np.argsort(x)
        # every cut into runs with rising means
        best = np.inf
        for cuts in itertools.product([0, 1], repeat=6):
            runs = np.split(y[order], [i + 1 for i, c in enumerate(cuts) if c])
            means = [r.mean() for r in runs]
            if all(a <= b for a, b in zip(means, means[1:])):
                best = min(best, sum(((r - r.mean()) ** 2).sum() for r in runs))
        fitted = ((y - np.interp(x, ends, levels)) ** 2).sum()
        assert fitted == pytest.approx(best)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    margin = toxicity.boost(x, y)(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97


def test_held_out_documents(frames):
    rows, docs, labels = frames
    truth = {i: y for i, _, y in rows}
    found = toxicity.judge(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert right > 0.97


def test_held_out_labels_do_not_reach_a_score(spark, frames):
    rows, docs, labels = frames
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    assert sorted(toxicity.judge(docs, labels).collect()) == sorted(toxicity.judge(docs, turned).collect())


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1), (5, 0), (6, 0), (7, 0), (99, 1)], "doc_id long, toxic int"
    )
    none = labels.limit(0)
    for some in (labels, none, labels.where("toxic = 1"), labels.where("toxic = 0")):
        found = toxicity.judge(odd_documents, some)
        assert found.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = found.collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 1 for r in toxicity.judge(odd_documents, labels.where("toxic = 1")).collect())
    assert toxicity.judge(no_documents, labels).count() == 0
    kept = toxicity.accepted(odd_documents, none)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
    assert toxicity.accepted(no_documents, none).count() == 0


def test_text_ids(spark, frames):
    _, docs, labels = frames
    as_text = lambda df: df.withColumn("doc_id", df.doc_id.cast("string"))
    rows = toxicity.judge(as_text(docs), as_text(labels)).collect()
    assert len(rows) == 900 and all(isinstance(r.doc_id, str) and 0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows} == {True, False}


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    found = {r.doc_id: r for r in REGISTRY["op4_toxicity"](spark, folder).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in truth if found[i].held_out]
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.85
