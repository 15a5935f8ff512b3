import random
import zlib

import numpy as np
import pytest

from tidewire.llm import langid

SYLLABLES = {"aa": "ka to mi ru ne so", "bb": "sch ein ung cht der zu", "cc": "eau oui que les ais ont"}


def documents(rng, n):
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        yield i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30))), lang


def test_gram_counts_do_not_depend_on_cutting(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("ab c", k=400))
    at, counts = langid.gram_counts(text)
    assert counts.sum() > 0 and len(at) == len(set(at.tolist()))
    upper = langid.gram_counts(text.upper())
    assert upper[0].tolist() == at.tolist() and upper[1].tolist() == counts.tolist()
    one = langid.gram_counts("ab")
    # a space on both sides: 4 single characters, 3 pairs, 2 triples
    assert one[1].sum() == 9
    assert langid.gram_counts("")[1].sum() == langid.gram_counts("12 !")[1].sum()


def test_long_texts_are_counted_whole(monkeypatch):
    text = "abc " * 1000
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "AT_ONCE", 500)
    parts = langid.gram_counts(text)
    assert parts[1].sum() >= whole[1].sum()
    assert set(whole[0].tolist()) <= set(parts[0].tolist())


def test_the_penalty_leaves_few_weights():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        at = np.unique(np.append(rng.integers(10, langid.BUCKETS, 20), i % 2))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at))), i % 2))
    weights = langid.follow_the_leader(rows, 2)
    assert weights[0, 0] > 0 > weights[0, 1] and weights[1, 1] > 0 > weights[1, 0]
    assert (weights != 0).mean() < 0.05


def test_temperature_is_the_best_one():
    rng = np.random.default_rng(1)
    logits = rng.standard_normal((4000, 3))
    targets = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert langid.fit_temperature(4 * logits, targets) == pytest.approx(4, rel=0.15)
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(list(documents(random.Random(3), 600)), "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.97


def test_more_than_64_languages_are_learned(spark):
    rng = random.Random(5)
    rows = []
    for k in range(70):
        own = [chr(0x4E00 + 40 * k + j) for j in range(6)]
        rows += [("".join(rng.choices(own, k=12)), f"l{k:02}") for _ in range(12 if k < 69 else 10)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == [f"l{k:02}" for k in range(70)]
    text, rarest = rows[-1]
    at, counts = langid.gram_counts(text)
    assert model.languages[int(model.probabilities(at, langid.weighted(at, counts, model.idf)).argmax())] == rarest


def test_labels_and_held_out_rows_do_not_reach_a_prediction(spark):
    rows = list(documents(random.Random(4), 300))
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    other = [(i, t, "zz" if i in held else lang) for i, t, lang in rows]
    kind = "doc_id long, text string, lang string"
    a, b = (langid.identify(spark.createDataFrame(x, kind)).collect() for x in (rows, other))
    assert sorted(a) == sorted(b)


def test_odd_documents(odd_documents, no_documents):
    found = langid.identify(odd_documents)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == odd_documents.count()
    texts = odd_documents.select("doc_id", "text").collect()
    unknown = sum(t.text is None or not any(c.isalpha() for c in t.text) for t in texts)
    assert sum(r.lang_pred == "und" and r.score == 0 for r in rows) == unknown
    assert langid.identify(no_documents).count() == 0
    kept = langid.accepted(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {2, 3, 10}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.accepted(no_documents).count() == 0


def test_number_signs_are_no_letters(spark):
    rows = list(documents(random.Random(4), 200)) + [(1000, "½ ²", None), (1001, "①", None), (1002, "Ⅷ 12_3", None), (1003, "½ ª", None)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 1000")
    told = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert told[1000] == told[1001] == told[1002] == ("und", 0.0)
    assert told[1003][0] in SYLLABLES


def test_without_labels_nothing_is_told(odd_documents):
    from pyspark.sql import functions as F

    rows = langid.identify(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    found = REGISTRY["op1_language_id"](spark, folder).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
