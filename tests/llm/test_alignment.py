import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewire.llm import alignment
from tidewire.llm.queries import REGISTRY

PATHS = public_tokenizers.path(alignment.BYTES), public_tokenizers.path(alignment.PIECES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def groups_of(text, libraries):
    """Groups of whole texts by walking both lists of ends, with the libraries as they are."""
    a, b = libraries
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letter = alignment._byte_letters()
    entries = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b
    ]
    want = (" " + text).encode()
    if b"".join(entries) != want or b"".join(pieces) != want:
        return []
    out, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(ids_a) or j < len(ids_b):
        if x <= y:
            left.append(ids_a[i])
            x += len(entries[i])
            i += 1
        else:
            right.append(ids_b[j])
            y += len(pieces[j])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out


def brute(rows, libraries):
    groups = [groups_of(t, libraries) for _, t in rows]
    linked = [Counter((x, y) for left, right in g for x in left for y in right) for g in groups]
    count = Counter(p for pairs in linked for p in pairs)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g, pairs in zip(rows, groups, linked):
        listed = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in g)
        out.append((
            i, sum(len(left) for left, _ in g), sum(len(right) for _, right in g), len(g), sum(pairs.values()),
            sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items()), listed,
        ))
    return sorted(out, key=repr)


def found(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, n long, groups string")
    result = alignment.align(frame, *PATHS)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted(map(tuple, result.collect()), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a \n b ", "\nword", "word\n\n\nword  ", "\r\nx\r\n\r\ny;\r z", "tab\there\t\tthere", "a\x00b",
    "it's we'll THEY'RE", "<|endoftext|>", "<s> </s><unk> <0x0A>", "a▁b", "▁", "nbsp\xa0here\xa0 two  thin　wide", "日本語のテキスト と 漢字",
    "🙂🙂 é ½ ² ⅷ ① ​ zero", "x" * 5000, "=" * 700 + " " * 300 + "-" * 900, "1234567890 12.5e-7 #!?", "ſ\x1c \x1d\x1f İ\x85z", "ééé ñ ß",
]


def test_odd_texts(spark, libraries):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "a b"), (3, "a b")]
    assert found(spark, rows) == brute(rows, libraries)


@pytest.mark.parametrize("hot", [0, 40, 500_000])
def test_made_texts(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "AT_ONCE", 700)
    rng = random.Random(hot)
    letters = "aeinrst AEI  .,'\n\r\t-0189éüß日\xa0▂"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 120)))) for i in range(120)]
    assert found(spark, rows) == brute(rows, libraries)


def test_memory_is_given_up(spark, libraries):
    aligner = alignment.Aligner(*PATHS)
    rng = random.Random(9)
    alignment_of = lambda t: [aligner.groups[i] for i in aligner.numbers([t])[0]]
    texts = ["".join(rng.choices("abc \n", k=50)) for _ in range(50)]
    first = [alignment_of(t) for t in texts]
    aligner.size = alignment.REMEMBERED_BYTES + 1
    assert [alignment_of(t) for t in texts] == first
    assert aligner.size < 50 * 60


def test_group_ends_against_sets():
    rng = random.Random(1)
    for _ in range(300):
        a, b, want, stops, base = [], [], [], [], 0
        for _ in range(rng.randint(1, 4)):
            last = base + rng.randint(1, 60)
            left, right = (sorted({last, *rng.sample(range(base + 1, last + 1), rng.randint(0, last - base))}) for _ in range(2))
            want += [(len(a) + left.index(s) + 1, len(b) + right.index(s) + 1) for s in sorted(set(left) & set(right))]
            a, b, base = a + left, b + right, last
            stops.append((len(a), len(b)))
        ends = alignment.group_ends(np.array(a), np.array(b), *np.array(stops).T)
        assert list(zip(*(e.tolist() for e in ends))) == want


def test_large_groups_without_cuts(libraries):
    aligner = alignment.Aligner(*PATHS)
    rng = random.Random(2)
    for text in ["".join(rng.choices("日é", k=400)), "x" * 9000]:
        aligner.reset()
        aligner.learn([" " + text])
        groups = groups_of(text, libraries)
        pairs = Counter(x * aligner.width + y for left, right in groups for x in left for y in right)
        assert dict(zip(aligner.codes.tolist(), aligner.times.tolist())) == pairs


def test_odd_and_no_documents(spark, odd_documents, no_documents, libraries):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, alignment.align(odd_documents, *PATHS).collect()), key=repr) == brute(rows, libraries)
    assert alignment.align(no_documents, *PATHS).collect() == []


def test_query(spark, folder, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    want = [(*w[:-1], digest(w[-1])) for w in brute(rows, libraries)]
    result = REGISTRY["op13_token_alignment"](spark, folder)
    assert result.columns[-1] == "groups_sha256"
    assert sorted(map(tuple, result.collect()), key=repr) == want
