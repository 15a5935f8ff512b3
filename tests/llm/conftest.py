import random

import pytest

from tidewire.llm.common import ship

#: Columns beside the documents' own whose names the operators use themselves.
CLASHES = "score double, fingerprint string, term string, row long, n long, key long, held boolean, label long, e string, ids string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def words(rng, n, letters="aeioustrnl"):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(k)) for k in n]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, clashing columns."""
    rng = random.Random(4)
    plain = words(rng, [30, 12, 50])
    rows = [
        (1, plain[0], "en", "a", 5), (1, plain[0], "en", "a", 5), (2, None, "en", "a", 5), (None, plain[1], "fr", None, None),
        (3, "", "fr", "b", 0), (4, plain[0], None, "b", 1), (5, " \n\t ", "en", "b", 2), (5, plain[2], "fr", "c", 3),
        (6, " ".join(words(rng, [60_000])), "en", "c", None), (7, "x" * 300_000, None, None, None), (8, "日本 🙂 ½ ſ\x1c İ\x00é", "fr", "d", 1),
        (9, "<|endoftext|> a<|startoftext|>", "en", "d", 1), (None, None, None, None, None), (10, "12 34 !!", "en", "d", 1),
    ]
    extra = (1.5, "ff", "t", 7, 7, 7, True, 9, "e", "i")
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
