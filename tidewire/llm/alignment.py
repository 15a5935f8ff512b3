"""Operator 13: the tokens of two tokenizers, aligned by their shared cuts.

A text is encoded by a byte-level vocabulary (A, with a space in front) and a piece vocabulary (B, which adds its
own). Byte offsets where tokens of both end cut the tokens into groups. Each A token of a group is linked with each B
token of it; a pair of ids counts in how many documents it is linked.

Cuts are found by divide and conquer: of an interval, the common end nearest to the middle is located by bisecting the
other side's ends; both halves follow, and an interval without such an end is a group. White space after other
characters begins a token in both vocabularies, so it is a cut that need not be looked for: texts are split there,
and what lies between, a chunk, is encoded and aligned once per worker and remembered; memory is bounded.

Two passes over the texts: the first counts documents per pair of ids, summed per task before the shuffle; in the
second the counts of a bounded number of frequent pairs go to every worker, and a text's other pairs join
the table of counts, so no key of that join is hot.

Defined results: null and empty texts, and texts whose tokens don't give their bytes again (those with U+2581, which B
takes for a space), have no tokens: all numbers are zero and the groups empty. Repeated rows are documents each.
Ids are of any type and stay as they are. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import own, text_of
from tidewire.session import cut

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks and their bytes that a worker remembers; characters of the texts taken at once, and of chunks encoded at once.
REMEMBERED, REMEMBERED_BYTES, AT_ONCE, ENCODED = 400_000, 32 << 20, 2 << 20, 1 << 16
#: Pairs whose counts go to every worker; pairs that a task holds before it hands their counts on.
HOT, HELD = 500_000, 2_000_000
#: Links of a group that are listed; those of a larger one are counted per distinct id.
MOST_LINKS = 4096

# A's pattern of pre-tokens, and white space of both vocabularies.
_PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = "\t-\r \x85\xa0  -     　"

_worker: dict = {}


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of both sides up to the end of every group.

    The ends are those of the tokens of all chunks in a row, rising; the stops are the numbers of tokens up to each
    chunk's end. All open intervals are halved together. One that finds no common end tries twice as many places next.
    """
    a1, b1 = stops_a, stops_b
    a0, b0 = np.concatenate(([0], a1[:-1])), np.concatenate(([0], b1[:-1]))
    tried = np.zeros(len(a1), dtype=np.int64)
    done = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    while len(a1):
        open_ = a1 - a0 - tried > 0
        open_ &= (a1 - a0 > 1) & (b1 - b0 > 1)
        done.append((a1[~open_], b1[~open_]))
        a0, a1, b0, b1, tried = (x[open_] for x in (a0, a1, b0, b1, tried))
        if not len(a1):
            break
        tries = np.maximum(tried, 1)
        first = np.cumsum(tries) - tries
        of = np.repeat(np.arange(len(a1)), tries)
        step = np.arange(len(of)) - first[of] + tried[of]
        # Places by their distance from the middle: 0, 1, -1, 2, -2, ... The last end of an interval cuts nothing.
        at = ((a0 + a1 - 1) >> 1)[of] + np.where(step & 1, (step + 1) >> 1, -(step >> 1))
        inside = (at >= a0[of]) & (at < a1[of] - 1)
        at = np.where(inside, at, a0[of])
        found = np.searchsorted(ends_b, ends_a[at])
        hit = np.flatnonzero(inside & (ends_b[found] == ends_a[at]))
        who, nearest = np.unique(of[hit], return_index=True)
        at, found = at[hit[nearest]] + 1, found[hit[nearest]] + 1
        rest = np.ones(len(a1), dtype=bool)
        rest[who] = False
        none = np.zeros(len(who), dtype=np.int64)
        a0, a1, b0, b1, tried = (
            np.concatenate(parts)
            for parts in (
                (a0[who], at, a0[rest]), (at, a1[who], a1[rest]), (b0[who], found, b0[rest]), (found, b1[who], b1[rest]),
                (none, none, (tried + tries)[rest]),
            )
        )
    ends = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(ends[0])
    return ends[0][order], ends[1][order]


def _byte_letters() -> dict[str, int]:
    """What byte each character of A's entries stands for: itself, or from U+0100 on the ones not printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _tiktoken(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both vocabularies, and the chunks that were aligned already, by number."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        byte_of, size = _byte_letters(), self.a.get_vocab_size()
        self.raw_a = [b""] * size
        ranks = {}
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.raw_a[i] = bytes(byte_of[c] for c in entry)
            ranks[self.raw_a[i]] = i
        ranks = {raw: i for raw, i in ranks.items() if i not in self.a.get_added_tokens_decoder()}
        self.fast = _tiktoken(ranks)
        self.sizes_a = np.array([len(r) for r in self.raw_a], dtype=np.int64)
        self.width = self.b.get_piece_size()
        texts = [self.b.id_to_piece(i) for i in range(self.width)]
        self.raw_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(texts)
        ]
        self.sizes_b = np.array([len(r) for r in self.raw_b], dtype=np.int64)
        self.space = self.b.piece_to_id("▁")
        # White space that a piece has after another character doesn't end a chunk.
        tied = {c for i, p in enumerate(texts) if not self.b.is_byte(i) for c in re.findall(f"(?<=.)[{_WHITE}]", p, re.S)} - {" "}
        go_on = "".join(re.escape(c) for c in sorted(tied)) or "^\\s\\S"
        self.chunk = re.compile(f"[{_WHITE}]*[^{_WHITE}]+(?:[{go_on}][{_WHITE}]*[^{_WHITE}]*)*|[{_WHITE}]+")
        self.library_only = re.compile(f"[^\x00-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[{_WHITE}]\\Z")
        self.spelled = [f"{i}{mark}" for i in range(max(size, self.width)) for mark in (",", "|", ";", "")]
        self.reset()

    def reset(self) -> None:
        none = np.empty(0, dtype=np.int64)
        self.number: dict[str, int] = {}
        self.size = 0
        self.stats = np.empty((0, 5), dtype=np.int64)  # of every chunk: A and B tokens, groups, links, whether its bytes came out
        self.codes, self.times = none, none  # of every chunk its pairs and how often each is linked
        self.ends = np.zeros(1, dtype=np.int64)
        self.groups: list[str] = []
        self.sums: np.ndarray | None = None

    def _ids_a(self, chunks: list[str], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many there are up to each chunk's end.

        Chunks are independent of each other, so a row of them is encoded as one text: by a library that merges the same ranks,
        but for letters other than common Latin ones and chunks that end in white space.
        """
        out, first, bytes_first = [np.empty(0, dtype=np.int64)], 0, 0
        alone = [bool(self.library_only.search(c)) for c in chunks]
        while first < len(chunks):
            last, size = first + 1, len(chunks[first])
            while last < len(chunks) and size < ENCODED and not alone[last] and not alone[first]:
                size += len(chunks[last])
                last += 1
            text = "".join(chunks[first:last])
            ids = self.a.encode(text, add_special_tokens=False).ids if alone[first] else self.fast.encode_to_numpy(text, disallowed_special=())
            out.append(np.asarray(ids, dtype=np.int64))
            first = last
        ids = np.concatenate(out)
        return ids, np.searchsorted(np.cumsum(self.sizes_a[ids]), bounds, side="right")

    def _ids_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of B. The space that the library puts in front is the chunk's own or goes again."""
        spaced = [c[0] == " " for c in chunks]
        out, stops = array("q"), []
        for ids, own_space in zip(self.b.encode([c[1:] if s else c for c, s in zip(chunks, spaced)], num_threads=1), spaced):
            # The library gives nothing for nothing, so a chunk of one space has no ids yet.
            out.extend((ids or [self.space]) if own_space else ids[1:])
            stops.append(len(out))
        return np.array(out, dtype=np.int64), np.array(stops, dtype=np.int64)

    def learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        encoded = [c.encode() for c in chunks]
        bounds = np.cumsum([len(e) for e in encoded])
        a, stops_a = self._ids_a(chunks, bounds)
        b, stops_b = self._ids_b(chunks)
        starts_a, starts_b = np.concatenate(([0], stops_a[:-1])), np.concatenate(([0], stops_b[:-1]))
        whole = np.ones(len(chunks), dtype=bool)
        for ids, raw, stops, sizes in ((a, self.raw_a, stops_a, self.sizes_a), (b, self.raw_b, stops_b, self.sizes_b)):
            spelled = [raw[i] for i in ids.tolist()]
            done = np.concatenate(([0], np.cumsum(sizes[ids])))
            if b"".join(spelled) != b"".join(encoded) or not np.array_equal(done[stops], bounds):
                starts = np.concatenate(([0], stops[:-1]))
                whole &= [b"".join(spelled[i:j]) == e for i, j, e in zip(starts.tolist(), stops.tolist(), encoded)]
        # Chunks whose bytes don't come out have no tokens.
        if not whole.all():
            a, b = a[np.repeat(whole, stops_a - starts_a)], b[np.repeat(whole, stops_b - starts_b)]
        n_a, n_b = np.where(whole, stops_a - starts_a, 0), np.where(whole, stops_b - starts_b, 0)
        groups, links, codes, times, of, texts = self._aligned(a, b, n_a, n_b)
        for chunk, text in zip(chunks, texts):
            self.number[chunk] = len(self.groups)
            self.groups.append(text)
            self.size += len(chunk)
        self.stats = np.concatenate([self.stats, np.stack([n_a, n_b, groups, links, whole], axis=1).astype(np.int64)])
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.searchsorted(of, np.arange(len(chunks)), side="right")])

    def _aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        """Of chunks with so many tokens: groups, links, pairs with their number and chunk, and the listed groups."""
        stops_a, stops_b, some = np.cumsum(n_a), np.cumsum(n_b), n_a > 0
        to_a, to_b = group_ends(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]), stops_a[some], stops_b[some])
        from_a, from_b = np.concatenate(([0], to_a[:-1])).astype(np.int64), np.concatenate(([0], to_b[:-1])).astype(np.int64)
        g_a, g_b = to_a - from_a, to_b - from_b
        chunk = np.searchsorted(stops_a, to_a)
        groups = np.bincount(chunk, minlength=len(n_a))
        links = np.bincount(chunk, g_a * g_b, minlength=len(n_a)).astype(np.int64)

        small = np.flatnonzero(g_a * g_b <= MOST_LINKS)
        each = (g_a * g_b)[small]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        g = np.repeat(small, each)
        keys = chunk[g] << 32 | (a[from_a[g] + place // g_b[g]] * self.width + b[from_b[g] + place % g_b[g]])
        keys, times = _counted(keys)
        for i in np.flatnonzero(g_a * g_b > MOST_LINKS).tolist():
            left, right = (np.unique(x[f:t], return_counts=True) for x, f, t in ((a, from_a[i], to_a[i]), (b, from_b[i], to_b[i])))
            more = (left[0][:, None] * self.width + right[0]).ravel()
            keys, times = np.append(keys, chunk[i] << 32 | more), np.append(times, (left[1][:, None] * right[1]).ravel())
        if len(small) < len(g_a):
            keys, times = _merged(keys, times)

        # Tokens in the order in which they are listed, each with the mark after it.
        listed = np.empty(len(a) + len(b), dtype=np.int64)
        g_of_a, g_of_b = np.repeat(np.arange(len(g_a)), g_a), np.repeat(np.arange(len(g_b)), g_b)
        mark = np.zeros(len(a), dtype=np.int64)
        mark[to_a - 1] = 1
        listed[np.arange(len(a)) + from_b[g_of_a]] = 4 * a + mark
        mark = np.zeros(len(b), dtype=np.int64)
        mark[to_b - 1] = 2
        mark[stops_b[some] - 1] = 3
        listed[np.arange(len(b)) + to_a[g_of_b]] = 4 * b + mark
        spelled = list(map(self.spelled.__getitem__, listed.tolist()))
        ends = (stops_a + stops_b).tolist()
        texts = ["".join(spelled[i:j]) for i, j in zip([0, *ends], ends)]
        return groups, links, keys & 0xFFFFFFFF, times, keys >> 32, texts

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts by number, and where each text's start (and the last ones end)."""
        if len(self.groups) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.reset()
        split = [self.chunk.findall(" " + t) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.number)))
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        return found, np.concatenate(([0], np.cumsum([len(c) for c in split]))).astype(np.int64)

    def pairs(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of the chunks: place in ``chunks``, pair, how often it is linked."""
        sizes = self.ends[chunks + 1] - self.ends[chunks]
        total = np.cumsum(sizes)
        at = np.repeat(self.ends[chunks] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return np.repeat(np.arange(len(chunks)), sizes), self.codes[at], self.times[at]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; by sorting, which is quicker here than a table of hashes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(np.append(first, len(keys)))


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _worker:
        _worker[paths] = Aligner(*paths)
    return _worker[paths]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``AT_ONCE`` bytes of text."""
    done = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(batch):
        last = max(int(np.searchsorted(done, (done[first - 1] if first else 0) + AT_ONCE)), first + 1)
        yield batch.slice(first, last - first)
        first = last


def _whole(aligner: Aligner, chunks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of every chunk, and which texts are encoded whole."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    bad = np.bincount(text, aligner.stats[chunks, 4] == 0, minlength=len(starts) - 1)
    return text, bad == 0


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _count(paths: tuple[str, str]):
    """Documents per pair, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes, counts = _merged(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for part in _slices(batch, 0):
                chunks, starts = aligner.numbers(part.column(0).to_pylist())
                if not len(chunks):
                    continue
                text, whole = _whole(aligner, chunks, starts)
                once, _ = _counted((text << 32 | chunks)[whole[text]])
                at, codes, _ = aligner.pairs(once & 0xFFFFFFFF)
                of, _ = _counted((once >> 32)[at] << 40 | codes)
                codes, counts = _counted(of & ((1 << 40) - 1))
                held.append((codes, counts))
                size += len(codes)
                if size > HELD:
                    held = [_merged(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def _sum(paths: tuple[str, str], shared, digest: bool):
    """The numbers of every text, its sums over frequent pairs, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        hot, values = shared.value
        aligner.sums = None
        known = 0
        for batch in batches:
            for part in _slices(batch, 0):
                chunks, starts = aligner.numbers(part.column(0).to_pylist())
                if aligner.sums is None:
                    aligner.sums, known = np.empty((0, 3), dtype=np.int64), 0
                if known < len(aligner.groups):
                    # Of every new chunk: best links and counts over its frequent pairs, and whether it has others.
                    of, codes, times = aligner.pairs(np.arange(known, len(aligner.groups)))
                    where = np.minimum(np.searchsorted(hot, codes), max(len(hot) - 1, 0))
                    is_hot = hot[where] == codes if len(hot) else np.zeros(len(codes), dtype=bool)
                    grown = np.zeros((len(aligner.groups) - known, 3), dtype=np.int64)
                    for i in (0, 1):
                        added = np.where(is_hot, values[where, i] * times, 0) if len(hot) else np.zeros(len(codes), dtype=np.int64)
                        np.add.at(grown[:, i], of, added)
                    grown[of[~is_hot], 2] = 1
                    aligner.sums, known = np.concatenate([aligner.sums, grown]), len(aligner.groups)
                yield _row_numbers(aligner, part, chunks, starts, hot, digest)

    return run


def _row_numbers(aligner: Aligner, part: pa.RecordBatch, chunks: np.ndarray, starts: np.ndarray, hot: np.ndarray, digest: bool) -> pa.RecordBatch:
    n = len(part)
    text, whole = _whole(aligner, chunks, starts)
    of_chunk = np.concatenate([aligner.stats[chunks, :4], aligner.sums[chunks, :2]], axis=1)
    totals = np.zeros((len(chunks) + 1, 6), dtype=np.int64)
    np.cumsum(of_chunk, axis=0, out=totals[1:])
    numbers = np.where(whole[:, None], totals[starts[1:]] - totals[starts[:-1]], 0)
    cold = np.flatnonzero((aligner.sums[chunks, 2] > 0) & whole[text])
    at, codes, times = aligner.pairs(chunks[cold])
    if len(codes) and len(hot):
        other = hot[np.minimum(np.searchsorted(hot, codes), len(hot) - 1)] != codes
        at, codes, times = at[other], codes[other], times[other]
    keys, times = _merged(text[cold][at] << 40 | codes, times)
    ends = np.searchsorted(keys >> 40, np.arange(n + 1))
    pairs = pa.StructArray.from_arrays([pa.array(keys & ((1 << 40) - 1)), pa.array(times)], ["pair", "times"])
    groups = []
    for ok, a, b in zip(whole.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        listed = ";".join(map(aligner.groups.__getitem__, chunks[a:b].tolist())) if ok else ""
        groups.append(hashlib.sha256(listed.encode()).hexdigest() if digest and listed else listed)
    columns = [*part.columns[1:], *(pa.array(c) for c in numbers.T.copy()), pa.array(groups, pa.string())]
    rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([*columns, rest], [*part.schema.names[1:], *_NUMBERS, "groups", "rest"])


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def pair_counts(docs: DataFrame, bytes_path: str, pieces_path: str, text_column: str = "text") -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked and whether that is the highest count of its A id. ``pair`` is
    the A id times the number of B's pieces, plus the B id."""
    texts = docs.select(text_of(text_column).alias("text"))
    counts = texts.mapInArrow(_count((bytes_path, pieces_path)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("a", F.expr(f"pair div {_width(pieces_path)}")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return cut(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")


def _width(pieces_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()


def _hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs above the least power of two that leaves at most ``most``."""
    bands = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("band")).count().collect()
    kept, band = 0, 64
    for row in sorted(bands, key=lambda r: -r["band"]):
        if kept + row["count"] > most:
            break
        kept, band = kept + row["count"], row["band"]
    found = counts.where(F.col("n") >= F.lit(float(2**band))).toArrow().sort_by("pair")
    pair, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    return pair, np.stack([best, n], axis=1)


def align(
    docs: DataFrame, bytes_path: str, pieces_path: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False
) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is the SHA-256 of that text, empty where
    there are no tokens. The paths are those of the vocabularies' files on every machine.
    """
    spark, row = docs.sparkSession, own("row")
    counts = pair_counts(docs, bytes_path, pieces_path, text_column)
    shared = spark.sparkContext.broadcast(_hot_pairs(counts, HOT))
    rows = docs.select(text_of(text_column).alias("text"), F.col(id_column).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    read = rows.mapInArrow(
        _sum((bytes_path, pieces_path), shared, digest), f"id {kind}, {numbers}, groups string, rest array<struct<pair:long,times:long>>"
    )
    read = cut(read.withColumn(row, F.monotonically_increasing_id()), "aligned")
    travelling = read.select(row, F.inline("rest"))
    added = travelling.join(counts, "pair").groupBy(row).agg(
        F.sum(F.col("best") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_count")
    )
    found = read.drop("rest").join(added, row, "left")
    more = {"n_best": "more_best", "count_sum": "more_count"}
    return found.select(
        F.col("id").alias(id_column),
        *[(F.col(c) + F.coalesce(F.col(more[c]), F.lit(0))).alias(c) if c in more else F.col(c) for c in _NUMBERS],
        "groups",
    )
