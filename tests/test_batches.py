"""Batch tables: what readers see, repeats, merging, and tables built on them."""

import pytest
from pyspark.sql import functions as F

from tidewire.sources.batches import BatchTable


def rows_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, n bigint")


def held(table):
    return sorted((r["k"], r["n"], r["batch_id"]) for r in table.read().collect())


def test_a_reader_sees_old_rows_until_the_manifest_names_new_ones(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(0, rows_of(spark, ("a", 1)))
    before = table.read()
    # A try that dies before its manifest: its rows are there, but no reader sees them.
    table._put(rows_of(spark, ("x", 9)), 1)
    assert held(table) == [("a", 1, 0)]
    table.write(0, rows_of(spark, ("a", 2), ("b", 3)))
    assert [(r["k"], r["n"]) for r in before.collect()] == [("a", 1)]
    assert held(table) == [("a", 2, 0), ("b", 3, 0)]


def test_order_schema_and_second_writer(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    table.write(3, rows_of(spark, ("a", 1)))
    with pytest.raises(ValueError):
        table.write(2, rows_of(spark, ("a", 1)))
    with pytest.raises(ValueError):
        table.write(4, spark.range(1))
    other = BatchTable(spark, str(tmp_path / "t"))
    stale = other.versions()
    table.write(4, rows_of(spark, ("a", 1)))
    other.versions = lambda: stale
    with pytest.raises(Exception, match="FileAlreadyExists"):
        other._commit("k string", [])


def test_merging_keeps_all_rows_and_few_folders(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    for batch in range(10):
        assert table.write(batch, rows_of(spark, ("a", 1), (f"k{batch}", 1)))
        table.merge(total, fan=3)
    live = table.manifest()["live"]
    assert [(e["level"], e["ranges"]) for e in live] == [(2, [[0, 8]]), (0, [[9, 9]])]
    assert not table.write(4, rows_of(spark, ("a", 100)))
    got = {r["k"]: r["n"] for r in total(table.read()).collect()}
    assert got == {"a": 10, **{f"k{b}": 1 for b in range(10)}}


def test_vacuum_deletes_only_what_no_kept_version_names(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    for n in range(4):
        table.write(0, rows_of(spark, ("a", n)))
    table.vacuum(kept=2)
    assert len(table.versions()) == 2 and len(table._names("batch_id=0")) == 2
    assert held(table) == [("a", 3, 0)]


def test_empty_batches_and_partitions(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), ("k",))
    table.write(0, rows_of(spark))
    assert held(table) == []
    table.write(1, rows_of(spark, ("a", 1), ("b", 2)))
    table.write(2, rows_of(spark))
    assert held(table) == [("a", 1, 1), ("b", 2, 1)]
    assert table.read().filter("k = 'a'").count() == 1


EDGE = "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint"


def edges_of(spark, **weights):
    return spark.createDataFrame([("Person", k, "KNOWS", "Person", "z", w) for k, w in weights.items()], EDGE)


@pytest.mark.parametrize("fold, expected", [("summed", {"a": 7, "b": 2, "c": 4}), ("newest", {"a": 4, "b": 2, "c": 4})])
def test_weights_over_runs(spark, tmp_path, fold, expected):
    from tidewire.operators import weights

    kept = weights.EdgeWeights(spark, str(tmp_path / "w"), getattr(weights, fold), fan=2)
    read = lambda: {r["src"]: r["weight"] for r in kept.read().collect()}
    kept.add(0, edges_of(spark, a=1, b=2))
    kept.add(1, edges_of(spark, a=9))
    assert not kept.add(1, edges_of(spark, a=9))
    merged = kept.table.manifest()["live"]
    assert [(e["level"], e["ranges"]) for e in merged] == [(1, [[0, 1]])]
    kept.add(2, edges_of(spark, a=50, c=4))
    # The repeat of a run that is not merged yet replaces it; the merged folder is the same one, unread and unwritten.
    kept.add(2, edges_of(spark, a=4, c=4))
    assert kept.table.manifest()["live"][0] == merged[0]
    assert read() == (expected | {"a": 14} if fold == "summed" else expected)
    assert kept.read(["OTHER"]).count() == 0


def test_an_added_run_reads_no_stored_edges(spark, tmp_path):
    from tidewire.operators.weights import EdgeWeights

    kept = EdgeWeights(spark, str(tmp_path / "w"))
    kept.add(0, edges_of(spark, a=1))
    # Stored rows that cannot be read any more would fail whatever reads them.
    for file in (tmp_path / "w").glob("batch_id=0/*/*/*.parquet"):
        file.write_bytes(b"broken")
    for crc in (tmp_path / "w").glob("batch_id=0/*/*/.*.crc"):
        crc.unlink()
    assert kept.add(1, edges_of(spark, a=2))
    with pytest.raises(Exception):
        kept.read().collect()
