"""Operator 5: language-model scores by a subword lattice.

A word, with the mark of a word's beginning in front, is the sum over all its segmentations into pieces
of an existing vocabulary: a forward recursion in log space over the lattice of pieces that fit. The
vocabulary and its scores are given; the scores start the piece probabilities, which one pass of
expectations over the distinct training words then adapts, each word weighing the same. A character that
is no piece goes by its bytes. A word met in training has one arc more, over the whole word, that
weighs its count; what the pieces weigh beside it is the share of words met once (Good-Turing).

There is such a model for every training language and one for the rows without; time and the width of the
table of words grow with the number of languages. A text's probability is their mixture, weighed by their training documents, so it is a proper
marginal over models and segmentations; the language of a scored text is not used.

Words are counted over all documents. Their probabilities are computed once per distinct word and joined
to the documents' words (``terms``).

Defined results: a null or empty text has one token, its end. Rows without an id are scored but not
learned from. Without training rows N is 0 and pieces weigh by the vocabulary alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import fold, text_of
from tidewire.llm.terms import counted, row_sums
from tidewire.llm.vectors import matrix
from tidewire.session import cut

MODEL = "piece_bpe_32k.model"
BEGIN = "▁"
#: Weight of all languages' counts beside a language's own, and of all languages' pieces.
SHARED_WORDS, SHARED_PIECES, LEAST_PIECE = 0.02, 20.0, 1e-9
#: Words whose lattices are laid out at once.
AT_ONCE = 4000

_worker: dict = {}


def split(texts: list[bytes]) -> list[list[bytes]]:
    """A text's words with A-Z in lower case, and the end as the empty word. Of bytes, ``lower`` changes
    those letters only, and ``split`` parts at the blanks U+0009 to U+000D and U+0020 only."""
    return [[*t.lower().split(), b""] for t in texts]


class Pieces:
    """A vocabulary's pieces as a trie that numpy walks for many words at once. After the pieces come the
    256 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: library.is_byte(i) or library.is_control(i) or library.is_unknown(i)
        self.ids = [i for i in range(library.get_piece_size()) if not odd(i)]
        self.texts = [library.id_to_piece(i) for i in self.ids]
        rank = -np.array([library.get_score(i) for i in self.ids])
        self.size = len(self.ids) + 256
        weights = np.concatenate([1.0 / (np.maximum(rank, 0.0) + 100.0), np.full(256, 1e-6)])
        self.start = np.log(weights / weights.sum())
        chars = sorted({c for t in self.texts for c in t})
        self.code = np.full(0x110000, -1, dtype=np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.chars = len(chars)
        nodes, edges, ends = {"": 0}, {}, {}
        for piece, text in enumerate(self.texts):
            for i in range(len(text)):
                if text[: i + 1] not in nodes:
                    nodes[text[: i + 1]] = len(nodes)
                edges[nodes[text[:i]] * self.chars + int(self.code[ord(text[i])])] = nodes[text[: i + 1]]
            ends[nodes[text]] = piece
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.texts))

    def lay_out(self, words: list[str]) -> Lattices:
        texts = [BEGIN + w for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - first[owner]
        left = sizes[owner] - place
        compact = self.code[codes]
        at, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        starts, lengths, pieces = [], [], []
        alone = np.ones(len(codes), dtype=bool)
        for depth in range(self.longest):
            char = compact[at + depth]
            key = node * self.chars + char
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = (self.keys[where] == key) & (char >= 0)
            at, node = at[there], self.next[where[there]]
            piece = self.piece[node]
            hit = piece >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), depth + 1))
            pieces.append(piece[hit])
            if not depth:
                alone[at[hit]] = False
            more = left[at] > depth + 1
            at, node = at[more], node[more]
        # Characters that are no piece: one arc each, numbered after the bytes.
        lone, number = np.unique(codes[alone], return_inverse=True)
        starts.append(np.flatnonzero(alone))
        lengths.append(np.ones(len(number), dtype=np.int64))
        pieces.append(self.size + number)
        start, length, piece = map(np.concatenate, (starts, lengths, pieces))
        spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) + (self.size - 256) for c in lone.tolist()]
        return Lattices(start + owner[start], length, piece, place[start], first + np.arange(len(texts)), sizes, spelled)


class Lattices:
    """The arcs of many words' lattices. Word k's positions are nodes ``first[k]`` to ``first[k] + sizes[k]``."""

    def __init__(self, start, length, piece, place, first, sizes, spelled):
        self.first, self.last, self.spelled = first, first + sizes, spelled
        self.nodes = int(sizes.sum() + len(sizes))
        self._arcs = start, start + length, piece
        self._places = place, place + length
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)

    def _levels(self, level: np.ndarray, joint: np.ndarray) -> list[tuple]:
        """The arcs in order of ``level``, and inside a level those that meet in a node together."""
        order = np.argsort(level * self.nodes + joint, kind="stable")
        start, end, piece, level, joint = (x[order] for x in (*self._arcs, level, joint))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            heads = np.concatenate(([0], np.flatnonzero(np.diff(joint[a:b])) + 1))
            out.append((start[a:b], end[a:b], piece[a:b], heads, joint[a:b][heads]))
        return out

    def weights(self, pieces: np.ndarray) -> np.ndarray:
        """Log weights (piece, model), with a row for each character that goes by its bytes."""
        if not self.spelled:
            return pieces
        return np.concatenate([pieces, np.array([pieces[s].sum(axis=0) for s in self.spelled])])

    @staticmethod
    def _sum(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(x, heads, axis=0)
        sizes = np.diff(np.append(heads, len(x)))
        return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes, axis=0)), heads, axis=0))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log sums (node, model) over all ways from a word's first node."""
        ways = np.zeros((self.nodes, weights.shape[1]))
        for start, _, piece, heads, joint in self._levels(self._places[1], self._arcs[1]):
            ways[joint] = self._sum(ways[start] + weights[piece], heads)
        return ways

    def expected(self, weights: np.ndarray, ways: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, piece, expected uses) of all arcs under the only model."""
        back = np.zeros((self.nodes, 1))
        total = ways[self.last]
        # From the last place back.
        for start, end, piece, heads, joint in self._levels(self._places[0].max(initial=0) - self._places[0], self._arcs[0]):
            x = weights[piece] + back[end]
            back[joint] = self._sum(x, heads)
            word = self.owner[start]
            yield word, piece, np.exp(ways[start] + x - total[word])[:, 0]


def _pieces(path: str) -> Pieces:
    if path not in _worker:
        _worker[path] = Pieces(path)
    return _worker[path]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), AT_ONCE):
        yield order[at : at + AT_ONCE]


def _expect(path: str, models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        uses = np.zeros((pieces.size, models))
        for batch in batches:
            words, met = batch.column(0).to_pylist(), matrix(batch.column(1), models) > 0
            for some in _by_length(words):
                lattices = pieces.lay_out([words[i] for i in some])
                weights = lattices.weights(pieces.start[:, None])
                found = list(lattices.expected(weights, lattices.forward(weights)))
                word, piece, use = (np.concatenate(x) for x in zip(*found))
                by_model = use[:, None] * met[some][word]
                size = pieces.size + len(lattices.spelled)
                each = np.stack([np.bincount(piece, by_model[:, m], size) for m in range(models)], axis=1)
                uses += each[: pieces.size]
                for spelled, u in zip(lattices.spelled, each[pieces.size :]):
                    for byte in spelled:
                        uses[byte] += u
        piece, model = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(model.astype(np.int32)), pa.array(uses[piece, model])], ["piece", "model", "uses"]
        )

    return run


def _spell(path: str, shared, models: int):
    """Log10 probability (float) of every word by the pieces of every model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = _pieces(path), shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = np.empty((len(words), models), dtype=np.float32)
            for some in _by_length(words):
                lattices = pieces.lay_out([words[i] for i in some])
                out[some] = lattices.forward(lattices.weights(logs))[lattices.last] / np.log(10.0)
            spelled = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), models).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, spelled], [*batch.schema.names, "spelled"])

    return run


def score(docs: DataFrame, path: str, held_out: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. Rows that are
    held out, or whose ``held_out`` is null, teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"),
        held_out.alias("held"),
    )
    trained = ~F.col("held")
    sizes = rows.where(trained & F.col("lang").isNotNull()).groupBy("lang").count()
    names = [r.lang for r in sizes.orderBy(F.desc("count"), "lang").collect()]
    models = len(names) + 1
    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) if names else F.lit(0)
    part = F.coalesce(place.cast("int"), F.lit(0))
    part = F.when(trained, part).otherwise(-1)

    met = [F.sum(F.when(F.col("part") == m, F.col("n")).otherwise(0)) for m in range(models)]
    words = counted(rows, F.col("text"), split, F.coalesce(part, F.lit(-1)), raw=True).groupBy("term").agg(F.sum("n").alias("n"), F.array(*met).alias("c"))
    words = cut(words, "words")
    of = [F.col("c")[m] for m in range(models)]
    count = sum(of[1:], of[0])
    facts = words.agg(
        F.count_if(count > 0).alias("v"), *[F.sum(o).alias(f"n{m}") for m, o in enumerate(of)], *[F.count_if(o == 1).alias(f"once{m}") for m, o in enumerate(of)],
        *[F.sum(F.when(F.col("term") == "", o).otherwise(0)).alias(f"docs{m}") for m, o in enumerate(of)],
    ).first()
    tokens = [facts[f"n{m}"] or 0 for m in range(models)]
    total = sum(tokens)

    uses = words.where(count > 0).select("term", "c").mapInArrow(_expect(path, models), "piece int, model int, uses double")
    uses = uses.groupBy("piece", "model").agg(F.sum("uses").alias("uses")).toArrow()
    logs = spark.sparkContext.broadcast(_piece_logs(_pieces(path), uses, models))
    scored = cut(words.mapInArrow(_spell(path, logs, models), "term string, n long, c array<long>, spelled array<float>"), "spelled")

    values = [(count > 0).cast("double"), F.log10((count + 1.0) / F.lit(float(total + facts.v + 1)))]
    documents = [facts[f"docs{m}"] or 0 for m in range(models)]
    live = [m for m in range(models) if documents[m]] or [0]
    for m in live:
        new = min(max((facts[f"once{m}"] or 0) / max(tokens[m], 1), 1e-4), 0.5) if tokens[m] else 1.0
        whole = (1 - new) * ((1 - SHARED_WORDS) * of[m] / float(max(tokens[m], 1)) + SHARED_WORDS * count / float(max(total, 1)))
        by_pieces = F.col("spelled")[m].cast("double") + float(np.log10(new))
        # Both arcs end in the word's last node: their log sum, safe where the pieces' weight vanishes.
        values.append(
            F.when(whole > 0, F.greatest(F.log10(whole), by_pieces) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(F.log10(whole) - by_pieces))))
            .otherwise(by_pieces)
        )
    found = row_sums(rows.withColumn("held_out", F.coalesce("held", F.lit(False))), split, scored, values, ["doc_id", "held_out"], raw=True)
    shares = [float(np.log10(documents[m] / max(sum(documents), 1))) if sum(documents) else 0.0 for m in live]
    ways = [F.col("sums")[2 + i] + share for i, share in enumerate(shares)]
    top = F.greatest(*ways) if len(ways) > 1 else ways[0]
    mixed = F.log10(sum((F.pow(F.lit(10.0), w - top) for w in ways), F.lit(0.0))) + top
    return found.select(
        "doc_id", "held_out", F.col("terms").alias("n_tokens"), F.round(F.col("sums")[0]).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("sums")[1].alias("base_score"), mixed.alias("score"),
    )


def _piece_logs(pieces: Pieces, uses: pa.Table, models: int) -> np.ndarray:
    """Log probabilities (piece, model): expected uses, smoothed by those of all models."""
    table = np.zeros((pieces.size, models))
    table[uses.column("piece").to_numpy(), uses.column("model").to_numpy()] = uses.column("uses").to_numpy()
    if not table.sum():
        return np.repeat(pieces.start[:, None], models, axis=1)
    every = table.sum(axis=1) + 0.01 * len(table) * np.exp(pieces.start)
    every /= every.sum()
    own = table + SHARED_PIECES * every[:, None] + LEAST_PIECE
    return np.log(own / own.sum(axis=0))


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """The scores of ``docs``; crc32 of the id modulo 7 parts training from held-out rows."""
    return score(docs, path, F.when(F.col("doc_id").isNotNull(), fold("doc_id", 7) == 2))
