"""Operator 7: token counts.

The distinct pre-tokens of all texts are counted into tokens once each; a row's count is the sum over
its pre-tokens, by a join to its pre-token frequencies. No ids are made for texts.

Pre-tokens of common Latin texts come from a pattern that equals the vocabulary's on them, those of all
other texts from the library itself. A special string inside a text is a pre-token of its own, as the
library treats it.

Defined results: null and empty texts have no bytes and no tokens. Repeated rows are counted each; texts
are read whole, however long.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pieces, text_of
from tidewire.llm.terms import counted, row_sums
from tidewire.session import cut

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512

# Letters, numbers and white space up to U+017F; the vocabulary's special string.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
SPECIAL = "<|endoftext|>"
_PRETOKEN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Characters whose kind the pattern above doesn't know.
_OTHER = re.compile("[^\x00-ſ‐-‧‰-⁞₠-₿]")

_worker: dict = {}


def _library(path: str):
    if path not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker[path] = Tokenizer.from_file(path)
    return _worker[path]


def splitter(path: str):
    """A function from texts to their pre-tokens."""

    def one(text: str) -> list[str]:
        if SPECIAL in text:
            out: list[str] = []
            for i, segment in enumerate(text.split(SPECIAL)):
                out += [SPECIAL] * (i > 0) + one(segment)
            return out
        if _OTHER.search(text):
            split = _library(path).pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in split]
        return _PRETOKEN.findall(text)

    return lambda texts: [one(t) for t in texts]


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        for batch in batches:
            for part in pieces(range(0, len(batch), 5000), 1):
                rows = batch.slice(part[0], 5000)
                found = library.encode_batch_fast(rows.column(0).to_pylist(), add_special_tokens=False)
                tokens = pa.array([len(e.ids) for e in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, tokens], ["term", "n", "tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. ``path`` is the vocabulary's file."""
    split = splitter(path)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    distinct = counted(rows, F.col("text"), split).groupBy("term").agg(F.sum("n").alias("n"))
    terms = cut(distinct.mapInArrow(_measure(path), "term string, n long, tokens long"), "pre-tokens")
    tokens = F.col("sums")[0].cast("long")
    summed = row_sums(rows, split, terms, [F.col("tokens").cast("double")], ["doc_id", "n_bytes"])
    return summed.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
