import __spark_entry__
import corpus_pipeline
from tidewire.llm import langid, simhash, toxicity

NAMES = ["toxicity", "language_id", "simhash_neardup", "packing"]


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES


def test_stages_equal_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r.doc_id for r in frame.collect())

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(toxicity.judge(docs, labels).where("predicted = 0"))
    assert 0 < kept.count() < docs.count()

    told = stages["language_id"](spark, docs, folder)
    assert told.columns == docs.columns
    assert ids(told) == ids(langid.identify(docs).where(f"lang_pred <> 'und' and score >= {langid.CONFIDENT}"))

    first = stages["simhash_neardup"](spark, docs, folder)
    assert first.columns == docs.columns
    assert ids(first) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))

    pieces = stages["packing"](spark, docs, folder).collect()
    totals, whole = {}, {}
    for r in pieces:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r["length"]
        whole[r.doc_id] = r.doc_tokens
    assert totals == whole and sorted(totals) == ids(docs)


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    assert 0 < len(kept) < docs.count() and kept <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_and_no_documents(spark, folder, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns
