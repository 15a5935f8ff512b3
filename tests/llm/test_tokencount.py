import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import terms, tokencount

PATH = public_tokenizers.path(tokencount.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_pretokens_count_as_the_text(library):
    rng = random.Random(5)
    letters = [*"aabbcdest  .,'\n\t\r\x85\xa0\x1c\x1féßªº²½€—…‘’日本ا🙂İſŸẞ 　́_-019!@\x00", "'s", "'re", " the", "<|endoftext|>", "ing", "  "]
    split = tokencount.splitter(PATH)
    for _ in range(6000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 25)))
        found = split([text])[0]
        assert "".join(found) == text
        assert sum(count(library, p) for p in found) == count(library, text), repr(text)


@pytest.mark.parametrize("hot", [0, 3, 300_000])
def test_rows_that_travel_or_not(spark, library, hot, monkeypatch):
    monkeypatch.setattr(terms, "HELD", 10)
    rng = random.Random(6)
    rows = [(i % 40, " ".join(rng.choices(["the", "zebra", "xyzzy", "qq" * 50, "é"], k=rng.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = tokencount.splitter(PATH)
    distinct = {p for _, t in rows for p in split([t])[0]}
    table = spark.createDataFrame([(p, 1 + 5 * (p == " the"), count(library, p)) for p in distinct], "term string, n long, tokens long")
    summed = terms.row_sums(docs, split, table, [F.col("tokens").cast("double")], ["doc_id"], most=hot)
    want = sorted((i, float(count(library, t)), float(len(split([t])[0]))) for i, t in rows)
    assert sorted((r.doc_id, r.sums[0], float(r.terms)) for r in summed.collect()) == want


def test_hot_terms_are_bounded(spark):
    table = spark.createDataFrame([(f"t{i}", 1 << (i % 7)) for i in range(70)] + [("x" * 100, 1000)], "term string, n long")
    # A long term is hot too; their bytes are bounded together.
    assert terms.hot_terms(table, 25).count() == 21
    assert terms.hot_terms(table, 5).count() == 1
    assert terms.hot_terms(table, 1).count() == 0
    assert terms.hot_terms(table, 1000).count() == 71
    assert terms.hot_terms(table.limit(0), 10).count() == 0


def test_odd_documents(odd_documents, no_documents, library):
    found = tokencount.count_tokens(odd_documents, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [(r.doc_id, r.text or "") for r in odd_documents.select("doc_id", "text").collect()]
    want = [(i, len(t.encode()), count(library, t), count(library, t) > 512) for i, t in texts]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())
    assert tokencount.count_tokens(no_documents, PATH).count() == 0


def test_query(spark, folder, library):
    from tidewire.llm.queries import REGISTRY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = REGISTRY["op7_token_counts"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        n = count(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
