import hashlib
import random

import pytest

from tidewire.llm import substrings
from tidewire.llm.queries import REGISTRY



def words(rng, n, letters):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(k)) for k in n]


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) of every row; of windows, the first in order of the rows stays."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        parts = (rows[i][1] or "").encode().split()
        gone = set()
        for at in range(len(parts) - window + 1):
            key = tuple(parts[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        kept = b" ".join(w for j, w in enumerate(parts) if j not in gone).decode()
        out.append((rows[i][0], len(parts), len(gone), kept))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    frame = spark.createDataFrame([(i, t, 1, 2.0, "k") for i, t in rows], "doc_id long, text string, ord int, tie double, kept string")
    result = substrings.without_repeats(frame, **settings)
    assert result.columns == ["doc_id", "n_words", "n_removed", "kept"]
    return sorted(map(tuple, result.collect()), key=repr)


def passages(rng, documents, repeats):
    """Documents of new words in which some passages come again, cut anywhere."""
    shared = [t.split() for t in words(rng, [60] * repeats, "abcdefgh")]
    rows = []
    for i in range(documents):
        parts = words(rng, [rng.randint(0, 80)], "abcdefgh")[0].split()
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            a = rng.randint(0, 45)
            at = rng.randint(0, len(parts))
            parts[at:at] = passage[a : rng.randint(a, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t", "\r\n"]).join(parts)))
    rows += [(documents + i, rows[i][1]) for i in range(0, documents, 7)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    rows = passages(random.Random(seed), 150, 4)
    want = brute(rows)
    assert any(w[2] for w in want)
    assert found(spark, rows) == want


def test_small_automata_one_anchor_over_several(spark, monkeypatch):
    monkeypatch.setattr(substrings, "REFERENCE_WORDS", 100)
    rows = passages(random.Random(3), 120, 2)
    assert found(spark, rows) == brute(rows)


def test_common_anchors_come_last_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_COMMON", 2)
    rows = passages(random.Random(4), 120, 2)
    assert found(spark, rows) == brute(rows)


def test_few_words_over_and_over(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 300)))) for i in range(20)]
    rows += [(20, "a " * 500), (21, "a b " * 200), (22, "b a " * 15)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("window", "anchor"), [(1, 5), (3, 2), (7, 7)])
def test_other_windows(spark, window, anchor):
    rows = passages(random.Random(6), 40, 3)
    assert found(spark, rows, window=window, anchor=anchor) == brute(rows, window)


def test_text_ids_are_ordered_as_texts(spark):
    passage = words(random.Random(7), [30], "abcdefgh")[0]
    frame = spark.createDataFrame([("b", passage), ("a10", passage), ("a9", passage), (None, passage)], "name string, body string")
    result = substrings.without_repeats(frame, "name", "body")
    assert {r["name"]: r.n_removed for r in result.collect()} == {"a10": 0, "a9": 30, "b": 30, None: 30}


def test_automaton_against_a_set():
    rng = random.Random(8)
    for _ in range(60):
        automaton, seen, at = substrings.Automaton(), {}, 0
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(6)]
        places = []
        for s in sequences:
            automaton.add(s, at)
            places.append(at)
            for i in range(len(s) - 2):
                seen.setdefault(tuple(s[i : i + 3]), at + i)
            at += len(s)
        for s, p in zip(sequences, places):
            assert automaton.earlier(s, p, 3) == [i for i in range(len(s) - 2) if seen[tuple(s[i : i + 3])] < p + i]


def test_odd_documents(spark, odd_documents, no_documents):
    result = substrings.without_repeats(odd_documents)
    rows = {(r.doc_id, r.kept): r for r in result.collect()}
    assert result.count() == odd_documents.count()
    assert (2, "") in rows and (3, "") in rows and (5, "") in rows
    lengths = sorted((r.n_words, r.n_removed) for r in result.collect() if r.doc_id == 1)
    assert lengths == [(30, 0), (30, 30)]
    assert rows[(4, "")].n_removed == 30
    assert rows[(7, "x" * 300_000)].n_words == 1
    assert rows[(6, next(k for i, k in rows if i == 6))].n_words == 60_000
    assert substrings.without_repeats(no_documents).collect() == []


def test_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    assert sorted(map(tuple, REGISTRY["op11_substring_dedup"](spark, folder).collect())) == sorted(want)
