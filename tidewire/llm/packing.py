"""Operator 9: packing along a space-filling curve.

Every document becomes token ids and one end id. Its hashed token counts are projected to a few
dimensions; the place on the Hilbert curve through them is the sort key, so neighbours on the curve use
alike words. The table is cut into ranges of the key, by quantiles of all keys, and sorted inside each,
and every range cuts its run of ids into sequences, which start anew in it. The rest at a partition's end becomes sequences
whose lengths are powers of two, so no id is dropped and nothing is padded.

Long documents travel as rows of at most ``ROW_IDS`` ids. Ties on the curve are broken by a hash of the
id, so copies spread over partitions like other rows.

Ids are those of the tokenizers library. No id depends on what is beyond white space, so each distinct
chunk between white space is encoded once and remembered: its words by the vocabulary's merges, a chunk of
other letters than common Latin ones by the library as it is.

Defined results: a null text is empty and has the end id alone; repeated rows are packed each; an empty
table gives an empty one.
"""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewire.llm.common import text_of
from tidewire.session import cut

VOCABULARY = "word_bpe_49k.json"
SEQUENCE, END_ID, ROW_IDS = 2048, 1, 16_384
#: Hash buckets of a document vector, dimensions it is projected to, bits of the curve in each.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
#: Rows of one place on the curve fall into so many keys; ids of one partition.
TIES, LEAST_IDS, MOST_IDS = 4096, 1 << 20, 1 << 26
#: Chunks that a worker remembers, and documents whose chunks are told apart at once.
REMEMBERED, AT_ONCE = 250_000, 2000

# Letters, numbers and white space up to U+017F; the vocabulary's special strings.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
_SPECIAL = r"<\|(?:startoftext|endoftext)\|>"
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
)
_WORD_OR_END = re.compile("\n|" + _WORD.pattern)
#: Chunks that need the library as a whole. The separators U+001C to U+001F are no white space to it.
_OTHER = re.compile(f"[^\x00-\x1b\x20-ſ‐-‧‰-⁞₠-₿]|İ|{_SPECIAL}")

_worker: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Stands for the mark of a word's end in byte sequences; no UTF-8 text holds it.
_WORD_END = b"\xff"


def _merger(path: str, suffix: str = "</w>"):
    """A function from a word's bytes to its ids, by the vocabulary's merges.

    Ids rise in the order of the merges, the bytes with the end mark first, so merging always the pair of
    the smallest id, leftmost first, merges as the vocabulary says.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, special = content["model"]["vocab"], {t["content"] for t in content["added_tokens"]}
    byte_of = {letter: b for b, letter in _byte_letters().items()}
    ranks = {}
    for piece, i in vocabulary.items():
        spelled = piece.removesuffix(suffix)
        if piece not in special:
            raw = bytes(byte_of[c] for c in spelled)
            if _WORD_END not in raw:
                ranks[raw + _WORD_END if spelled != piece else raw] = i
    ranks[_WORD_END] = len(vocabulary)
    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: merge(word.encode() + _WORD_END)


class Words:
    """Ids of chunks between white space, as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.merge = Tokenizer.from_file(path), _merger(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk."""
        for held in (self.chunks, self.words):
            if len(held) > REMEMBERED:
                held.clear()
        new = [c for c in chunks if c not in self.chunks]
        text = "\n".join(new)
        if _OTHER.search(text):
            for c in filter(_OTHER.search, new):
                self.chunks[c] = array("H", self.library.encode(c, add_special_tokens=False).ids).tobytes()
            new = [c for c in new if c not in self.chunks]
            text = "\n".join(new)
        # One pass over all of them. A line feed, which no chunk holds, is a word of its own between them.
        words = _WORD_OR_END.findall(text.lower())
        words.append("\n")
        merge = self.merge
        for word in set(words).difference(self.words, "\n"):
            self.words[word] = array("H", merge(word)).tobytes()
        known, at = self.words.__getitem__, 0
        for c in new:
            first, at = at, words.index("\n", at) + 1
            self.chunks[c] = known(words[first]) if at == first + 2 else b"".join(map(known, words[first : at - 1]))
        return list(map(self.chunks.__getitem__, chunks))


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row as 16-bit numbers, without special ones around a text, and where each
    text's ids start (and the last ones end).

    No id depends on what is beyond white space, so texts are split there, and each distinct chunk is
    looked up once; the texts' ids are then gathered from the chunks'.
    """
    if path not in _worker:
        _worker[path] = Words(path)
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    chunks = split.flatten().dictionary_encode()
    index = chunks.indices.to_numpy(zero_copy_only=False)
    ids = _worker[path].ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
    pool = np.frombuffer(b"".join(ids), "<u2")
    lengths = sizes[index]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    begin = (np.cumsum(sizes) - sizes)[index] - ends[:-1]
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    flat = pool[np.repeat(begin.astype(kind), lengths) + np.arange(ends[-1], dtype=kind)]
    counts = split.value_lengths().to_numpy(zero_copy_only=False)
    return flat, ends[np.concatenate(([0], np.cumsum(counts)))]


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, BUCKETS, 1 << 16), rng.standard_normal((BUCKETS, DIMENSIONS))


def document_points(flat: np.ndarray, starts: np.ndarray, bucket: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The projected, length-normalised vectors of square roots of hashed counts, of texts with the end id."""
    out = []
    for first in range(0, len(starts) - 1, 500):
        part = starts[first : first + 501]
        n = len(part) - 1
        row = np.repeat(np.arange(n) * BUCKETS, np.diff(part))
        counts = np.bincount(row + bucket[flat[part[0] : part[-1]]], minlength=n * BUCKETS).reshape(n, BUCKETS)
        counts[:, bucket[END_ID]] += 1
        vectors = np.sqrt(counts)
        out.append(vectors @ axes / np.sqrt(counts.sum(axis=1, keepdims=True)))
    return np.concatenate(out) if out else np.empty((0, axes.shape[1]))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (row, dimension) below 2 ** bits.

    Bit planes are taken from the top; each turns or mirrors the planes below it, the last step reads the
    Gray code off and weaves the planes together.
    """
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, low = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            is_set = (x[i] & bit) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap if i else x[0])
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> plane) & 1, (1 << plane) - 1, 0)
    key = np.zeros_like(turn)
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ turn) >> plane) & 1)
    return key


_POINT = [f"p{i}" for i in range(DIMENSIONS)]
_TOKENS = "doc_id long, start long, ids binary, doc_tokens long, " + ", ".join(f"{p} float" for p in _POINT)
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, axes = _projection()
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows: list[list] = [[], [], [], []]
                points = []
                flat, starts = encode(part.column(1), path)
                found = document_points(flat, starts, bucket, axes)
                for doc, a, b, point in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), found):
                    ids = flat[a:b].tobytes() + end
                    for first in range(0, len(ids), 2 * ROW_IDS):
                        for column, value in zip(rows, (doc, first // 2, ids[first : first + 2 * ROW_IDS], len(ids) // 2)):
                            column.append(value)
                        points.append(point)
                grid = np.array(points, dtype=np.float32).reshape(len(points), DIMENSIONS)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(r, k) for r, k in zip(rows, kinds)), *(pa.array(g) for g in grid.T)],
                    ["doc_id", "start", "ids", "doc_tokens", *_POINT],
                )
        pa.default_memory_pool().release_unused()

    return run


def curve_place(spread: list[tuple[float, float]], cuts: list[int]) -> Column:
    """``key``, the curve's key of the point columns with the ``tie`` column below it, and ``part``, which
    range between the cuts holds it. Every dimension is spread evenly by its mean and deviation."""
    ends = np.array(cuts, dtype=np.int64)

    def place(tie: pa.Array, *points: pa.Array) -> pa.Array:
        cells = []
        for values, (mean, deviation) in zip(points, spread):
            z = (values.to_numpy(zero_copy_only=False).astype(float) - mean) / max(deviation, 1e-12)
            cells.append(np.minimum((1 << BITS) / (1 + np.exp(-1.702 * np.clip(z, -30, 30))), (1 << BITS) - 1).astype(np.int64))
        keys = hilbert_key(np.stack(cells, axis=1)) * TIES + tie.to_numpy(zero_copy_only=False)
        part = np.searchsorted(ends, keys).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(part)], ["key", "part"])

    kind = StructType([StructField("key", LongType()), StructField("part", IntegerType())])
    return F.arrow_udf(place, kind)("tie", *_POINT)


class _Sequences:
    """Cuts a run of ids into sequences of one partition."""

    def __init__(self, part: int):
        self.next = part << 40
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.filled = 0

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.rows.append((doc, start, len(ids), ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1
        self.open, self.filled = [], 0

    def add(self, doc: int, start: int, ids: np.ndarray, total: int, size: int = SEQUENCE) -> None:
        at = 0
        while at < len(ids):
            taken = ids[at : at + size - self.filled]
            self.open.append((doc, start + at, taken, total))
            self.filled += len(taken)
            at += len(taken)
            if self.filled == size:
                self._close()

    def end(self) -> None:
        left, todo = self.filled, self.open
        self.open, self.filled = [], 0
        for piece in todo:
            doc, start, ids, total = piece
            while len(ids):
                size = 1 << (left.bit_length() - 1)
                taken = ids[: size - self.filled]
                self.open.append((doc, start, taken, total))
                self.filled += len(taken)
                start, ids = start + len(taken), ids[len(taken) :]
                if self.filled == size:
                    left -= size
                    self._close()

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 7
        kinds = [pa.int64()] * 7
        arrays = [
            pa.array([ids.astype("<u4").tobytes() for ids in c], pa.binary()) if i == 3 else pa.array(c, k)
            for i, (c, k) in enumerate(zip(columns, kinds))
        ]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _cut_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sequences = _Sequences(TaskContext.get().partitionId())
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            for doc, start, ids, total in zip(*(part.column(i).to_pylist() for i in range(4))):
                sequences.add(doc, start, np.frombuffer(ids, "<u2"), total)
            yield sequences.take()
    sequences.end()
    yield sequences.take()


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence, and its ids.

    ``path`` is the vocabulary's file on every machine. ``ids`` holds little-endian 32-bit numbers;
    pieces of a sequence are gapless by ``offset``.
    """
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    tokens = cut(tokens.mapInArrow(_tokenize(path), _TOKENS), "tokens")
    spread = tokens.agg(*[f(p) for p in _POINT for f in (F.avg, F.stddev_pop)]).first()
    spread = [(spread[2 * i] or 0.0, spread[2 * i + 1] or 0.0) for i in range(DIMENSIONS)]
    # Copies share a place on the curve; a hash of the id orders them there.
    tokens = tokens.withColumn("tie", F.pmod(F.xxhash64("doc_id", "start"), F.lit(TIES)))
    total = tokens.agg(F.sum(F.octet_length("ids")) / 2).first()[0] or 0
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(wanted, math.ceil(total / LEAST_IDS)), math.ceil(total / MOST_IDS))
    # The boundaries need the points alone; the ids are read once, by the shuffle.
    shares = [i / parts for i in range(1, parts)]
    keys = tokens.select(curve_place(spread, []).alias("at")).select("at.key")
    cuts = keys.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] if shares else []
    placed = tokens.select("doc_id", "start", "ids", "doc_tokens", curve_place(spread, cuts or []).alias("at"))
    ordered = placed.select("doc_id", "start", "ids", "doc_tokens", "at.*").repartitionById(parts, "part")
    ordered = ordered.sortWithinPartitions("key", "doc_id", "start", "doc_tokens", "ids")
    return ordered.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(_cut_sequences, _PIECES)
