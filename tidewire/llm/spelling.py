"""Operator 12: spelling variants by Gram matrices of letter counts.

Words one edit apart differ little in their letters: a letter more or less is a squared distance of 1 between
their letter counts, another letter in its place one of 2. So pairs at most two apart are kept and their spelling
decides.

Words lie in blocks by how many letters of each group they hold; the groups share out the letters by how frequent they are, and
there are as many groups as keep the largest block at ``BLOCK`` words or fewer. An edit moves a word to a block next to
its own, of the same length or one longer, or leaves it there. Every block is sent to the blocks next to it, and a task
has one block and its visitors: a product of the two sides' counts, widened by their squared lengths, holds all squared distances.
All pairs are found; larger blocks than ``BLOCK``, where no more letters part the words, are compared in slices.

Every task sums up its pairs per word, so a word with very many near ones is a few rows. Forms are followed by doubling,
each round a written table.

Words: runs of letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are lower-cased. Where 31 divides the CRC-32 of
``<id>:<run>``, the run loses one letter. Distinct results of at least ``least_letters`` letters that occur at least twice are words.

Defined results: a null text has no runs; a null id counts as the empty text. Repeated rows count each. Ties of a form go to the
smaller word by code points. No words give an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import text_of
from tidewire.session import cut

LEAST_LETTERS, LEAST_TIMES, TIMES_MORE, CHANGED = 7, 2, 10, 31
#: Words of a block that are compared at once, groups of letters to start with, words that a task holds before it hands them on.
BLOCK, GROUPS, HELD = 4096, 3, 300_000
#: Bytes of words whose spelling is compared at once, and letters up to which squared lengths are exact in single precision.
AT_ONCE, SINGLE = 16 << 20, 2000


def _count(least: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = Counter(run.findall(text.as_py().lower().decode()))
                start = zlib.crc32(f"{name}:".encode())
                for word, n in found.items():
                    mark = zlib.crc32(word.encode(), start)
                    if mark % CHANGED:
                        held[word] += n
                    elif len(word) > least:
                        at = mark % len(word)
                        held[word[:at] + word[at + 1 :]] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    return count


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of every word of all texts."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), text_of(text_column))
    counts = rows.mapInArrow(_count(least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_TIMES)


def _key(groups: list[str]) -> Column:
    """How many letters of each group a word holds."""
    return F.concat_ws(",", *[F.length("word") - F.length(F.translate("word", g, "")) for g in groups])


def _shared_out(letters: list[tuple[str, int]], groups: int) -> list[str]:
    """Letters in groups of about equal frequency: the most frequent first, each to the group with least."""
    held, sizes = [""] * groups, [0] * groups
    for letter, n in sorted(letters, key=lambda x: (-x[1], x[0])):
        least = sizes.index(min(sizes))
        held[least] += letter
        sizes[least] += n
    return held


def letter_groups(words: DataFrame, block: int) -> list[str]:
    """As few groups of letters as give blocks of at most ``block`` words, or one of every letter."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    letters = [(r["letter"], r["count"]) for r in letters.collect()]  # at most 90, as words hold no others
    groups = GROUPS
    while groups < len(letters):
        found = _shared_out(letters, groups)
        if (words.groupBy(_key(found)).count().agg(F.max("count")).first()[0] or 0) <= block:
            return found
        groups += max(1, groups // 3)
    return [letter for letter, _ in letters]


_BLOCK = pa.schema([("block", pa.string()), ("home", pa.bool_()), ("letters", pa.int32()), ("words", pa.binary()), ("ns", pa.binary())])


def _send(rows: pa.Table) -> pa.Table:
    """A block at home, and as a visitor of the blocks that an edit of its words can lead to: a letter more, or another
    letter in place of one of a later group. The other ways round are visits of those blocks to this one."""
    key = rows.column("key")[0].as_py()
    counts = [int(c) for c in key.split(",")]
    words, ns = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    targets = [key]
    for i in range(len(counts)):
        more = [c + (k == i) for k, c in enumerate(counts)]
        targets.append(",".join(map(str, more)))
        targets += [",".join(str(c - (k == j)) for k, c in enumerate(more)) for j in range(i + 1, len(counts)) if counts[j]]
    out: dict[str, list] = {name: [] for name in _BLOCK.names}
    for first in range(0, len(words), BLOCK):
        data = "".join(words[first : first + BLOCK]).encode("latin-1")
        for target in targets:
            values = target, target == key, len(words[0]), data, ns[first : first + BLOCK].astype("<i8").tobytes()
            for name, value in zip(_BLOCK.names, values):
                out[name].append(value)
    return pa.table(out, _BLOCK)


def _letters(words: np.ndarray, used: np.ndarray, kind: type) -> np.ndarray:
    """Counts of the used letters in words of one length, a row of code points each."""
    place = np.zeros(256, dtype=np.int64)
    place[used] = np.arange(len(used))
    flat = place[words] + np.arange(len(words))[:, None] * len(used)
    return np.bincount(flat.ravel(), minlength=len(words) * len(used)).reshape(len(words), len(used)).astype(kind)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b``, words of one length each, ``a`` not the longer ones, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    before, after = a != b[:, :n], a != b[:, 1:]
    first = np.where(before.any(axis=1), before.argmax(axis=1), n)
    last = np.where(after.any(axis=1), n - 1 - after[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of words of ``a`` and ``b`` one edit apart; of a block with itself each pair once."""
    used = np.union1d(a, b).astype(np.int64)
    kind = np.float32 if max(a.shape[1], b.shape[1]) <= SINGLE else np.float64
    x, y = _letters(a, used, kind), _letters(b, used, kind)
    # (x, |x|^2, 1) times (-2y, 1, |y|^2) is the squared distance.
    x = np.concatenate([x, (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), kind)], axis=1)
    y = np.concatenate([-2 * y, np.ones((len(y), 1), kind), (y * y).sum(axis=1, keepdims=True)], axis=1)
    found = [(np.empty(0, dtype=np.int64),) * 2]
    step, room = max(1, (4 << 20) // max(len(b), 1)), max(1, AT_ONCE // b.shape[1])
    for at in range(0, len(a), step):
        i, j = np.nonzero(x[at : at + step] @ y.T < 2.5)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), room):
            p, q = i[part : part + room], j[part : part + room]
            near = _one_edit(a[p], b[q])
            found.append((p[near], q[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _meet(rows: pa.Table) -> pa.Table:
    """Of every word of a block and its visitors how many near ones it met, and the best of them."""
    sizes = rows.column("letters").to_pylist()
    blocks = [np.frombuffer(w.as_py(), np.uint8).reshape(-1, s) for w, s in zip(rows.column("words"), sizes)]
    ns = [np.frombuffer(n.as_py(), "<i8") for n in rows.column("ns")]
    base = np.concatenate(([0], np.cumsum([len(n) for n in ns])))
    home = [i for i, h in enumerate(rows.column("home").to_pylist()) if h]
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for place, i in enumerate(home):
        for j in range(len(blocks)):
            if j in home[:place]:
                continue
            p, q = near_pairs(blocks[j], blocks[i], i == j)
            left.append(p + base[j])
            right.append(q + base[i])
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    words, count = [bytes(w).decode("latin-1") for block in blocks for w in block], np.concatenate(ns)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[b], -count[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pa.table(
        {
            "word": [words[i] for i in a[first].tolist()], "n_near": np.diff(np.append(first, len(a))),
            "near": [words[i] for i in b[first].tolist()], "near_n": count[b[first]],
        },
        _NEAR,
    )


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n): near words of every word of ``words(word, n)`` that has some, and the most frequent of them."""
    keyed = words.select("word", "n", _key(letter_groups(words, block)).alias("key"))
    sent = cut(keyed.groupBy("key").applyInArrow(_send, "block string, home boolean, letters int, words binary, ns binary"), "word-blocks")
    there = sent.where("home").select("block").distinct()
    met = sent.join(there, "block", "left_semi").groupBy("block").applyInArrow(_meet, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    summed = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, whose forms lead in no circle: each round doubles the steps taken."""
    found = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = cut(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word.

    ``form`` is the near word that occurs most, where it occurs ``TIMES_MORE`` times as often as the word, and
    ``root`` the last one on the way from form to form.
    """
    words = cut(count_words(docs, id_column, text_column, least_letters), "words")
    near = near_words(words)
    is_form = F.col("near_n") >= TIMES_MORE * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    found = cut(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
