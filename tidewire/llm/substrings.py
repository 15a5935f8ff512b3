"""Operator 11: repeated passages out of texts, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document. A word goes when a window over it also starts
earlier: in a document with a smaller id, or further left in its own. What is left of a document is its other
words.

Equal windows hold equal runs of ``anchor`` words, and of these they choose the same one, the least by a hash. So the
windows of a document fall into segments, runs of windows that choose one and the same run of words, its anchor, and
equal windows always meet under equal anchors. Documents travel as compressed blocks:

1. Every block sends its distinct segments, as hashes, to the shards of their anchors.
2. A shard finds the first block of every segment. All others hold a repeat of it and lose it whole. An anchor that
   has several different segments is a reference: its first occurrences are asked for their words.
3. The words of references build a suffix automaton per reference shard, in the order of the documents; each state
   knows where its words ended first. Every segment is then streamed through the automaton for its matching
   statistics, held at the window's length: a window whose state ended earlier is a repeat.
4. Every block marks its repeats; the windows' union is the maximal spans, which go.

The automata are not sent to every executor: work would be documents times shards. Each stays in the one task whose
segments can match it. Anchors that very many documents share (at most ``COMMON``, known from counts per block) are chosen
last, so the edges of a common passage, which differ from document to document, meet under other anchors. An anchor
with more words than one automaton holds is streamed through several.

Words and runs of words are compared by 64-bit hashes, segments by the hashes of their anchor and their words together.

Defined results: a null text has no words. Rows with one id are documents of their own, ordered by a hash of
their text; of equal rows any one comes first. A null id comes after all others. Ids of other types than whole
numbers are ordered as Spark orders them. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewire.llm.common import own, text_of
from tidewire.session import cut

WINDOW, ANCHOR = 20, 5
#: Bytes of text of one block; segments of one shard; words of one automaton.
BLOCK_BYTES, SHARD_SEGMENTS, REFERENCE_WORDS = 8 << 20, 1 << 20, 100_000
#: Bytes whose words are hashed at once.
AT_ONCE = 1 << 19
#: Anchors chosen last, how many of them a block may name, and how often one must occur in its block.
COMMON, NAMED, LEAST_COMMON = 65_536, 1024, 16

_LAST = (1 << 63) - 1
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LETTERS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Ranges:
    """Hashes of ranges of a sequence, from one pass over it."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _powers(base, n), out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of all texts, and where each text's words start (and the last ones end)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    turns = inside[1:] != inside[:-1]
    # A text's end ends a word even where the next one goes straight on.
    joints = offsets[1:-1]
    joints = joints[(joints > 0) & (joints < len(data))]
    joints = np.unique(joints[inside[joints] & inside[joints + 1]])
    at = np.flatnonzero(turns)
    starts, ends = np.sort(np.append(at[::2], joints)), np.sort(np.append(at[1::2], joints))
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + AT_ONCE)), first + 1)
        low = starts[first]
        letters = _Ranges(_LETTERS[data[low : ends[last - 1]]], _WORD_BASE)
        hashes[first:last] = letters(starts[first:last] - low, ends[first:last] - low)
        first = last
    return hashes, np.searchsorted(starts, offsets)


class Segments:
    """The segments of the documents of one block: which windows and which anchor each has."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int, anchor: int, common: np.ndarray):
        self.window, self.words = window, words
        n = len(words)
        doc_end = np.repeat(starts[1:], np.diff(starts))
        place = np.arange(n)
        self.at = np.flatnonzero(place + window <= doc_end)
        self.doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        if not len(self.at):
            self.first = self.size = self.owner = np.empty(0, dtype=np.int64)
            self.anchor = self.content = np.empty(0, dtype=np.uint64)
            return
        ranges = _Ranges(words, _BASE)
        runs = np.arange(n - anchor + 1)
        names = ranges(runs, runs + anchor)
        # Hash above, place below, so the least tells both; of equal ones the leftmost. The top bit puts common ones last.
        low = np.uint64(max(int(n).bit_length(), 1))
        order = _mixed(names) >> np.uint64(1)
        if len(common):
            found = np.searchsorted(common, names)
            order |= (common[np.minimum(found, len(common) - 1)] == names).astype(np.uint64) << np.uint64(63)
        order = (order >> low << low) | runs.astype(np.uint64)
        wide, span = window - anchor + 1, 1
        while 2 * span <= wide:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        if span < wide:
            order = np.minimum(order[: len(order) - (wide - span)], order[wide - span :])
        chosen = (order[self.at] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(chosen), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (self.doc[self.at[1:]] != self.doc[self.at[:-1]])
        first = np.flatnonzero(new)
        self.size = np.diff(np.append(first, len(chosen)))
        self.first = self.at[first]
        self.owner = self.doc[self.first]
        self.anchor = names[chosen[first]]
        self.content = ranges(self.first, self.first + self.size + window - 1)
        # The same windows with their anchor elsewhere in them are another segment.
        self.content ^= _mixed(chosen[first].astype(np.uint64) - self.first.astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of every kind of segment in order of its hashes, and the kind of every segment.

        Documents of a block are in order, so the first by place is the first by order.
        """
        order = np.lexsort((self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        return order[new], kind


class Automaton:
    """Suffix automaton of sequences, which are added one after another; every state knows where its words ended first."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ended = [-1], [0], [-1]

    def _state(self, after: dict[int, int], link: int, length: int, ended: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ended.append(ended)
        return len(self.next) - 1

    def _part(self, above: int, word: int) -> int:
        """The state for just the words that ``above`` and ``word`` make, split off where it also stands for longer ones."""
        found = self.next[above][word]
        length = self.length[above] + 1
        if self.length[found] == length:
            return found
        part = self._state(dict(self.next[found]), self.link[found], length, self.ended[found])
        self.link[found] = part
        at = above
        while at >= 0 and self.next[at].get(word) == found:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def add(self, words: list[int], place: int) -> None:
        """A sequence whose first word lies at ``place``; places of later sequences are larger."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for end, word in enumerate(words, place):
            if word in following[last]:
                last = self._part(last, word)
                continue
            new = self._state({}, 0, length[last] + 1, end)
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at >= 0:
                link[new] = self._part(at, word)
            last = new

    def earlier(self, words: list[int], place: int, window: int) -> list[int]:
        """Numbers of the windows of a sequence at ``place`` whose words ended earlier in what was added."""
        following, link, length, ended = self.next, self.link, self.length, self.ended
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
                # The statistic is needed up to the window's length only: step to the state of just the last words.
                while length[link[state]] >= window:
                    state = link[state]
                if matched >= window:
                    matched = window
                    if ended[state] < place + i:
                        out.append(i - window + 1)
        return out


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _segments(table: pa.Table, window: int, anchor: int, common: np.ndarray) -> tuple[Segments, np.ndarray]:
    words, starts = word_hashes(_texts(table))
    return Segments(words, starts, window, anchor, common), starts


def _to_blocks(window: int, anchor: int):
    """Rows of documents become blocks; each names the anchors that are frequent in it."""
    none = np.empty(0, dtype=np.uint64)

    def block(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).sort_by([("ord", "ascending"), ("tie", "ascending")]).combine_chunks()
        found, _ = _segments(table, window, anchor, none)
        names, counts = np.unique(found.anchor, return_counts=True)
        often = np.flatnonzero(counts >= LEAST_COMMON)
        often = often[np.argsort(-counts[often], kind="stable")][:NAMED]
        named = pa.array([[{"anchor": int(a), "n": int(n)} for a, n in zip(names[often].view(np.int64), counts[often])]], _NAMED)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([len(found.anchor)], pa.int64()), named, pa.array([_packed(table)], pa.binary())],
            ["block", "segments", "named", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                done = int(lengths[first - 1]) if first else 0
                last = max(int(np.searchsorted(lengths, done + BLOCK_BYTES - size)), first + 1 if not held else first)
                held.append(batch.slice(first, last - first))
                size += (int(lengths[min(last, len(batch)) - 1]) if last else 0) - done
                if last < len(batch):
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                first = last
        if held:
            yield block(number, held)

    return run


_NAMED = pa.list_(pa.struct([("anchor", pa.int64()), ("n", pa.int64())]))
_SENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("slot", "<u4"), ("doc", "<u4")])
_ORDER = np.dtype([("ord", "<i8"), ("tie", "<i8")])
_PLACED = np.dtype([("anchor", "<u8"), ("ord", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("slot", "<u4"), ("words", "<u4")])
_BITS = np.dtype([("slot", "<u4"), ("window", "<u4")])


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(shard[order[a]]), order[a:b]


def _order(table: pa.Table) -> np.ndarray:
    out = np.empty(table.num_rows, dtype=_ORDER)
    for name in ("ord", "tie"):
        out[name] = table.column(name).to_numpy()
    return out


def _send(shards: int, window: int, anchor: int, common: np.ndarray):
    """Of every block its distinct segments, to the shards of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                table = _unpacked(data.as_py())
                found, _ = _segments(table, window, anchor, common)
                first, _ = found.distinct()
                order = _order(table)
                for shard, at in _by_shard((found.anchor[first] % np.uint64(shards)).astype(np.int64)):
                    docs, doc = np.unique(found.owner[first[at]], return_inverse=True)
                    sent = np.empty(len(at), dtype=_SENT)
                    sent["anchor"], sent["content"] = found.anchor[first[at]], found.content[first[at]]
                    sent["slot"], sent["doc"] = at, doc
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([sent.tobytes()]), pa.array([order[docs].tobytes()])],
                        ["shard", "block", "segments", "docs"],
                    )

    return run


def _first_of_each(rows: pa.Table) -> pa.Table:
    """Per block of a shard: the segments that an earlier block has too, and those whose words are wanted."""
    blocks = rows.column("block").to_numpy()
    parts = [np.frombuffer(d.as_py(), _SENT) for d in rows.column("segments")]
    docs = [np.frombuffer(d.as_py(), _ORDER) for d in rows.column("docs")]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sent = np.concatenate(parts)
    base = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
    order = np.concatenate(docs)[base[row] + sent["doc"]]
    by = np.lexsort((blocks[row], order["tie"], order["ord"], sent["content"], sent["anchor"]))
    a, c = sent["anchor"][by], sent["content"][by]
    new_anchor = np.ones(len(by), dtype=bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new = new_anchor.copy()
    new[1:] |= c[1:] != c[:-1]
    contents = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
    several = np.repeat(contents > 1, np.diff(np.append(np.flatnonzero(new_anchor), len(by))))
    out: dict[str, list] = {"block": [], "repeats": [], "wanted": []}
    sides = [np.sort(by[~new]), np.sort(by[new & several])]
    cuts = [np.searchsorted(row[side], np.arange(len(parts) + 1)) for side in sides]
    for i in range(len(parts)):
        slots = [sent["slot"][side[c[i] : c[i + 1]]] for side, c in zip(sides, cuts)]
        if len(slots[0]) or len(slots[1]):
            out["block"].append(int(blocks[i]))
            out["repeats"].append(slots[0].tobytes())
            out["wanted"].append(slots[1].tobytes())
    return pa.table(out, pa.schema([("block", pa.int64()), ("repeats", pa.binary()), ("wanted", pa.binary())]))


def _slots(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column if v.is_valid), "<u4").astype(np.int64)


def _give_words(shards: int, window: int, anchor: int, common: np.ndarray):
    """The words of a block's wanted segments, to the reference shards."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "block": [], "segments": [], "words": []}
        wanted = _slots(asked.column("wanted"))
        if block.num_rows and len(wanted):
            table = _unpacked(block.column("data")[0].as_py())
            found, starts = _segments(table, window, anchor, common)
            first, _ = found.distinct()
            at, order = first[wanted], _order(table)
            sizes = found.size[at] + window - 1
            for shard, here in _by_shard((found.anchor[at] % np.uint64(shards)).astype(np.int64)):
                segment, size = at[here], sizes[here]
                placed = np.empty(len(here), dtype=_PLACED)
                doc = found.owner[segment]
                placed["anchor"], placed["ord"], placed["tie"] = found.anchor[segment], order["ord"][doc], order["tie"][doc]
                placed["start"], placed["slot"], placed["words"] = found.first[segment] - starts[doc], wanted[here], size
                ends = np.cumsum(size)
                words = found.words[np.repeat(found.first[segment] - (ends - size), size) + np.arange(ends[-1])]
                out["shard"].append(shard)
                out["block"].append(block.column("block")[0].as_py())
                out["segments"].append(placed.tobytes())
                out["words"].append(words.tobytes())
        return pa.table(out, pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("segments", pa.binary()), ("words", pa.binary())]))

    return run


def _stream(window: int, most: int):
    """Automata over the references of a shard, and the windows that each segment holds as a repeat."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        parts = [np.frombuffer(d.as_py(), _PLACED) for d in rows.column("segments")]
        words = np.concatenate([np.frombuffer(d.as_py(), "<u8") for d in rows.column("words")])
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        placed = np.concatenate(parts)
        ends = np.cumsum(placed["words"].astype(np.int64))
        starts = ends - placed["words"]
        order = np.lexsort((placed["start"], blocks[row], placed["tie"], placed["ord"], placed["anchor"]))
        size = placed["words"][order].astype(np.int64)
        place = np.cumsum(size) - size  # where a segment lies when all are read in order
        group = placed["anchor"][order]
        group_end = np.searchsorted(group, group, side="right")
        found = [np.empty((0, 2), dtype=np.int64)]
        first = 0
        while first < len(order):
            # An automaton takes whole anchors while they fit, or else a part of one.
            last = int(np.searchsorted(place, place[first] + most))
            if last < len(order) and last > group_end[first]:
                last = int(np.searchsorted(group, group[last]))
            last = max(last, first + 1)
            sequences = [words[starts[i] : ends[i]].tolist() for i in order[first:last]]
            automaton = Automaton()
            for at, sequence in zip(place[first:last].tolist(), sequences):
                automaton.add(sequence, at)
            hits: list[tuple[int, int]] = []
            for i, (at, sequence) in enumerate(zip(place[first:last].tolist(), sequences), first):
                hits += [(i, w) for w in automaton.earlier(sequence, at, window)]
            for i in range(last, int(group_end[last - 1])):
                hits += [(i, w) for w in automaton.earlier(words[starts[order[i]] : ends[order[i]]].tolist(), int(place[i]), window)]
            found.append(np.array(hits, dtype=np.int64).reshape(-1, 2))
            first = last
        every = np.concatenate(found)
        segment = order[every[:, 0]]
        bits = np.empty(len(every), dtype=_BITS)
        bits["slot"], bits["window"] = placed["slot"][segment], every[:, 1]
        out: dict[str, list] = {"block": [], "bits": []}
        for i, at in _by_shard(row[segment]):
            out["block"].append(int(blocks[i]))
            out["bits"].append(bits[at].tobytes())
        return pa.table(out, pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    return run


def _mark(window: int, anchor: int, common: np.ndarray):
    """The documents of a block without their repeats."""

    def run(block: pa.Table, marks: pa.Table) -> pa.Table:
        table = _unpacked(block.column("data")[0].as_py())
        found, starts = _segments(table, window, anchor, common)
        first, kind = found.distinct()
        gone = np.ones(len(kind), dtype=bool)
        gone[first] = False
        gone[first[_slots(marks.column("repeats"))]] = True
        ends = np.cumsum(found.size)
        windows = np.repeat(gone, found.size)
        bits = np.frombuffer(b"".join(v.as_py() for v in marks.column("bits") if v.is_valid), _BITS)
        at = first[bits["slot"].astype(np.int64)]
        windows[(ends - found.size)[at] + bits["window"]] = True
        turn = np.zeros(len(found.words) + 1, dtype=np.int32)
        np.add.at(turn, found.at[windows], 1)
        np.add.at(turn, found.at[windows] + window, -1)
        removed = np.cumsum(turn)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(removed)))
        n_removed = total[starts[1:]] - total[starts[:-1]]
        kept = []
        for text, n, a, b in zip(_texts(table).cast(pa.large_binary()), n_removed.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
            parts = text.as_py().split()
            kept.append(b" ".join([w for w, r in zip(parts, removed[a:b].tolist()) if not r] if n else parts))
        return pa.table({
            "id": table.column("id"), "n_words": pa.array(np.diff(starts), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def _ordered(docs: DataFrame, id_column: str) -> DataFrame:
    """``docs`` with ``ord``, a whole number in the order of the ids."""
    kind, last = docs.schema[id_column].dataType, F.lit(_LAST)
    if isinstance(kind, IntegralType):
        return docs.withColumn(own("ord"), F.coalesce(F.col(id_column).cast("long"), last))
    ids = docs.select(F.col(id_column).alias(own("id"))).where(F.col(own("id")).isNotNull()).distinct()
    ids = cut(ids.orderBy(own("id")).withColumn(own("ord"), F.monotonically_increasing_id()), "ids")
    joined = docs.join(ids, F.col(id_column) == F.col(own("id")), "left").drop(own("id"))
    return joined.withColumn(own("ord"), F.coalesce(own("ord"), last))


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """id, n_words, n_removed and kept, the words that stay, joined by one space, of every row."""
    anchor = min(anchor, window)
    rows = _ordered(docs.select(id_column, text_column), id_column)
    rows = rows.select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.col(own("ord")).alias("ord"),
        F.xxhash64(text_of(text_column)).alias("tie"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    blocks = cut(
        rows.mapInArrow(_to_blocks(window, anchor), "block long, segments long, named array<struct<anchor:long,n:long>>, data binary"), "blocks"
    )
    often = blocks.select(F.inline("named")).groupBy("anchor").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "anchor").limit(COMMON)
    common = np.sort(np.array([r.anchor for r in often.select("anchor").collect()], dtype=np.int64).view(np.uint64))
    total = blocks.agg(F.sum("segments")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_SEGMENTS))

    data = blocks.select("block", "data")
    sent = data.mapInArrow(_send(shards, window, anchor, common), "shard int, block long, segments binary, docs binary")
    answers = cut(sent.groupBy("shard").applyInArrow(_first_of_each, "block long, repeats binary, wanted binary"), "answers")
    asked = answers.where(F.octet_length("wanted") > 0).select("block", "wanted")
    references = data.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _give_words(shards, window, anchor, common), "shard int, block long, segments binary, words binary"
    )
    bits = references.groupBy("shard").applyInArrow(_stream(window, REFERENCE_WORDS), "block long, bits binary")
    marks = answers.select("block", "repeats", F.lit(None).cast("binary").alias("bits")).unionAll(
        bits.select("block", F.lit(None).cast("binary"), "bits")
    )
    found = data.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        _mark(window, anchor, common), f"id {kind}, n_words long, n_removed long, kept string"
    )
    return found.withColumnRenamed("id", id_column)
