import random
import re

import numpy as np
import pytest
import xxhash
from test_components import expected

from tidewire.llm import hamming, simhash
from tidewire.llm.hamming import HALVES


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def clustered(rng, centres, around, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.append(c)
        for _ in range(around):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def all_groups(prints):
    prints = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 3]
    return expected(links)


def test_fingerprint():
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "one TWO", "É é one", "a\x1cb\x85c d\xa0e f"]
    texts += [" ".join(rng.choices("the of And to in X is".split(), k=rng.randint(1, 40))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = " ".join(str(i) for i in range(70_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


@pytest.mark.parametrize("half", [0, 1])
def test_every_near_partner_is_visited(half):
    rng = random.Random(5)
    points = np.array(sorted(set(clustered(rng, 150, 6, 3))), dtype=np.uint64)
    tree, leaves = hamming.grow(points, HALVES[half], 3, 40)
    assert leaves > 3
    at, leaf, home = hamming.visits(tree, points)
    homes = dict(zip(at[home].tolist(), leaf[home].tolist()))
    assert len(homes) == len(points) == home.sum()
    seen = set(zip(at.tolist(), leaf.tolist()))
    near_half = np.bitwise_count((points[:, None] ^ points[None, :]) & HALVES[half]) <= 1
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    for i, j in zip(*np.nonzero(near & near_half)):
        assert (i, homes[j]) in seen


@pytest.mark.parametrize("centres,around,flips", [(300, 2, 4), (3, 150, 5), (1, 900, 3)])
def test_shards_find_all_groups(spark, centres, around, flips):
    rng = random.Random(centres)
    prints = [p - (1 << 64) if p >> 63 else p for p in set(clustered(rng, centres, around, flips))]
    from tidewire.llm.components import components

    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.label for r in components(simhash.link_fingerprints(frame, shard_points=60)).collect()}
    want = all_groups([p % (1 << 64) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(want[p % (1 << 64)], set()).add(p)
    ours = {}
    for p in prints:
        ours.setdefault(found.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in ours.values()}


def near_texts(rng):
    base = [" ".join(rng.choices(["w%d" % i for i in range(500)], k=400)) for _ in range(12)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + base[:3]


def brute(rows):
    groups = all_groups([plain_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        g = groups[plain_fingerprint(t)]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{plain_fingerprint(t):016x}", least.get(groups[plain_fingerprint(t)])) for i, t in rows), key=str)


def test_near_duplicates(spark):
    rows = list(enumerate(near_texts(random.Random(8)), 100))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert len({r.component_id for r in found}) < len(rows)


def test_odd_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(odd_documents)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 5, 6, 7, 8, 9, 10, None], key=str)
    assert simhash.one_of_each(no_documents).count() == 0


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, REGISTRY["op6_simhash_neardup"](spark, folder).collect()), key=str) == brute(rows)
