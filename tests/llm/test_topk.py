import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import topk

KIND = "vec_id long, embedding array<float>, label int, cid long, row long, score double"


def brute(rows, every=50, top=5):
    """All (query id, rank, id, score), with repeated rows."""
    good = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def found(spark, rows, every=50, top=5):
    frame = spark.createDataFrame([(i, v, 1, 2, 3, 4.0) for i, v in rows], KIND)
    result = topk.search(frame, F.col("vec_id") % every == 0, top)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, result.collect()))


def test_random_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "LEAST_ROWS", 40)
    monkeypatch.setattr(topk, "AT_ONCE", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(9).tolist()) for i in range(300)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_ties_copies_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 1)) for _ in range(4)]) for i in range(120)]
    rows += [(50, rows[50][1]), (50, [0.5] * 4), (7, rows[7][1]), (7, rows[7][1])]
    got, want = found(spark, rows, 25), brute(rows, 25)
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0 * i, -1.0]) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [5.0, 5.0]), (50, [0.0, 0.0]),
        (51, []), (52, [1.0]), (53, [1.0, 1.0, 9.0]), (100, [nan]), (150, None), (54, [-3.0, -4.0]),
    ]
    assert found(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(-(2**21)), 3.0]) for i in range(60)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_many_copies_of_a_query(spark):
    copies = spark.range(20_000).select((F.col("id") * 50).alias("vec_id"), F.array(F.lit(1.0), F.lit(-1.0)).cast("array<float>").alias("embedding"))
    others = spark.createDataFrame([(i, [float(i % 3), 0.5]) for i in range(1, 49)], "vec_id long, embedding array<float>")
    result = topk.search(copies.unionAll(others), F.col("vec_id") % 50 == 0)
    rows = result.where("query_id in (0, 50, 999950)").collect()
    best = [(i, 2 * 256 * 256) for i in (0, 50, 100, 150, 200, 250)]
    for q in (0, 50, 999950):
        assert sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q) == [
            (k + 1, *b) for k, b in enumerate([b for b in best if b[0] != q][:5])
        ]
    assert result.count() == 100_000


def test_copies_are_limited_before_the_shuffle(spark):
    ranked = spark.range(100).select((F.col("id") % 2).alias("v"), "id", F.col("id").alias("row"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))
    plan = ranked.withColumn("place", place).where("place <= 6")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_a_query_that_scores_all_rows_alike(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 300)] + [(0, [0.0] * 4), (350, [0.0] * 4)]
    assert found(spark, rows) == brute(rows)


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, REGISTRY["op10_topk"](spark, folder).collect())) == brute(rows)
