import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import spelling
from tidewire.llm.queries import REGISTRY


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def found(spark, rows, **settings):
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, word string")
    result = spelling.variants(frame, **settings)
    assert result.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, result.collect()))


def texts(rng, n, letters):
    """Texts of few words, frequent and rare, many of them with a slip."""
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(40)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 120)):
            word = words[min(int(rng.expovariate(0.15)), 39)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randint(0, len(word) - 1)
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + rng.randint(0, 1) :]])
            parts.append(word)
        out.append((i, rng.choice([" ", ", ", "\n", "1"]).join(parts)))
    return out


@pytest.mark.parametrize(("block", "letters"), [(4096, "abcABCé"), (20, "abcdE"), (3, "abÀÿ×")])
def test_texts(spark, monkeypatch, block, letters):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (block,))
    rows = texts(random.Random(block), 150, letters)
    want = brute(rows)
    assert any(w[3] for w in want) and any(w[3] != w[5] for w in want if w[3])
    assert found(spark, rows) == want


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 3, "zzzzzzy": 30, "zzzzzzx": 30}
    rows = [(None, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = {r[0]: r for r in found(spark, rows)}
    assert [got[w][5] for w in list(counts)[:4]] == ["aaaabbb"] * 4
    assert got["zzzzzzz"][3] == "zzzzzzx"
    assert sorted(got.values()) == brute(rows)


def test_pairs_of_blocks():
    rng = random.Random(3)
    for _ in range(40):
        n, more = rng.randint(1, 6), rng.randint(0, 1)
        a, b = ({"".join(rng.choices("aé", k=k)) for _ in range(12)} for k in (n, n + more))
        a, b = sorted(a), sorted(b)
        x, y = (np.array([list(w.encode("latin-1")) for w in s], dtype=np.uint8) for s in (a, b))
        got = {(a[i], b[j]) for i, j in zip(*spelling.near_pairs(x, y, False))}
        assert got == {(p, q) for p in a for q in b if one_edit(p, q)}


def test_long_words_are_exact(spark):
    rows = [(1, " ".join(["x" * 5000] * 2 + ["x" * 4999 + "y"] * 30 + ["x" * 4998 + "yy"] * 2 + ["x" * 5001] * 2))]
    assert found(spark, rows) == brute(rows)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, spelling.variants(odd_documents).collect())) == brute(rows)
    assert spelling.variants(no_documents).collect() == []
    assert spelling.variants(odd_documents.where("doc_id = 2")).collect() == []


def test_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, REGISTRY["op12_spelling_variants"](spark, folder).collect())) == brute(rows)
