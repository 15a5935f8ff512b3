"""Operator 2: exact SentencePiece BPE encoding and decoding by backtracking.

A text's merges end in the one sequence of pieces of which every neighbouring pair is *compatible*: the
pair's joined text, merged on its own, gives the pair again. So the encoder walks from the left, takes
the longest piece that an Aho-Corasick automaton finds at a position, checks it against the piece
before, falls back to shorter ones, and steps back where none fits. A bitfield remembers positions from
which there is no way on, so each is left for good once.

Two facts of a vocabulary split the work: no merge crosses two characters that are neighbours in no
piece, and a character that is in no piece stands alone as bytes. Both are read from the vocabulary. A
worker remembers what it encoded, as most words repeat, up to a number of bytes.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows are
encoded each; no row is dropped; texts are encoded whole, however long.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import text_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes that a worker remembers beside the chunks joined at once, how many these are, and what an entry costs beside its text.
REMEMBERED, AT_ONCE, ENTRY = 192 << 20, 200_000, 160

_worker: dict[str, Encoder] = {}


class Encoder:
    """Encodes and decodes with the vocabulary and scores of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.texts = [library.id_to_piece(i) for i in range(size)]
        self.scores = [library.get_score(i) for i in range(size)]
        odd = {i for i in range(size) if library.is_byte(i) or library.is_control(i) or library.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.texts) if i not in odd}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [
            b"" if library.is_control(i) or library.is_unknown(i)
            else bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.texts)
        ]
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        lone = {c for p in self.ids for c in p if c not in self.ids}
        if lone or any(n[1] == SPACE != n[0] for n in self.neighbours):
            raise ValueError("a vocabulary whose pieces go on past a space, or hold a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [i]:  # other pieces never come out of merging
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.size = size
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.held = 0
        # A line feed that no piece holds ends a chunk; it is frequent, so the pattern splits there.
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n")

    def merge(self, text: str) -> list[int]:
        """Ids of a short text by merging: the best-scored neighbours first, of equal ones the leftmost."""
        left = list(range(-1, len(text) - 1))
        right = [*range(1, len(text)), -1]
        symbols: list[str] = list(text)
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(joined := symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, joined, b))

        for at in range(len(text) - 1):
            offer(at, at + 1)
        while heap:
            _, a, joined, b = heapq.heappop(heap)
            if right[a] != b or not symbols[a] or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b], right[a] = joined, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[s] for s in symbols if s]

    def _fit(self, a: int, b: int) -> bool:
        known = self.fits[a * self.size + b] = self.merge(self.texts[a] + self.texts[b]) == [a, b]
        self.held += ENTRY
        return known

    def backtrack(self, part: str) -> list[int]:
        """Ids of a text of known characters."""
        starts: list[list[tuple[int, int]]] = [[] for _ in part]
        for end, found in self.automaton.iter(part):
            starts[end - found[0] + 1].append(found)
        starts.append([])
        fits, size, n = self.fits.get, self.size, len(part)
        failed, any_failed = bytearray(n // 8 + 1), False
        taken: list[tuple[int, int, int]] = []  # id, candidate, position
        at, before, candidate = 0, -1, len(starts[0]) - 1
        while at < n:
            found = starts[at]
            while candidate >= 0:
                length, i = found[candidate]
                end = at + length
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if before < 0:
                        break
                    fit = fits(before * size + i)
                    if fit or fit is None and self._fit(before, i):
                        break
                candidate -= 1
            if candidate >= 0:
                taken.append((i, candidate, at))
                at, before = end, i
                candidate = len(starts[at]) - 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                _, candidate, at = taken.pop()
                before = taken[-1][0] if taken else -1
                candidate -= 1
        return [i for i, _, _ in taken]

    def _part(self, part: str) -> bytes:
        ids = self.backtrack(part) if part[0] in self.ids else [self.byte_ids[b] for b in part.encode()]
        found = self.parts[part] = array("i", ids).tobytes()
        self.held += ENTRY + len(part) + len(found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        known, neighbours = self.parts.get, self.neighbours
        ids, first = b"", 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in neighbours:
                part = chunk[first:i]
                ids += known(part) or self._part(part)
                first = i
        part = chunk[first:]
        return ids + (known(part) or self._part(part))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers."""
        if not text:
            return b""
        known, text = self.chunks, SPACE + text.replace(" ", SPACE)
        if len(text) < AT_ONCE:
            blocks: Iterator[list[str]] = iter([self.chunk.findall(text)])
        else:
            walk = (m.group() for m in self.chunk.finditer(text))
            blocks = iter(lambda: list(islice(walk, AT_ONCE)), [])
        out = []
        for block in blocks:
            for chunk in set(block).difference(known):
                known[chunk] = ids = self._chunk(chunk)
                self.held += ENTRY + len(chunk) + len(ids)
            out.append(b"".join(map(known.__getitem__, block)))
            if self.held > REMEMBERED:
                self.forget()
        return b"".join(out)

    def forget(self) -> None:
        for held in (self.chunks, self.parts, self.fits):
            held.clear()
        self.held = 0

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes again."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [np.frombuffer(encoder.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                flat = np.concatenate([*rows, np.empty(0, np.int32)])
                ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int32()))
                texts = [encoder.decode(r.tolist()) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids give) of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(path), f"doc_id {kind}, ids array<int>, decoded string")
