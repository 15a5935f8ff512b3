"""Operator 10: exact top-k inner products by a uniform threshold in three phases.

A vector's components are cut into ``SLICES`` ranges; a score is the sum of the slices' parts. Rows and
queries are dealt to blocks, and one task sees one slice of one block of rows and one block of queries.

1. Every task gathers its local list, the k best parts of each query. The best of these per query and
   slice are resolved to whole scores; the k-th best of them is a floor under the k-th best score.
2. A row at or above the floor has a part of at least floor / SLICES in some slice. That cutoff goes out
   with the queries, and every task sends the entries that reach it.
3. Entries go back to their block of rows and block of queries, where whole vectors meet, so all scores are exact; those below
   the floor go there, and the k best stay.

Equal vectors are one candidate with its smallest ids, so copies add no work. No list is cut short: a
weak cutoff sends more entries, it never loses one.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows without an id. Shorter vectors count as ending in zeros. Repeated rows are candidates each; a row
is not its own candidate. Ties go to the smaller id. Scores must fit into a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.vectors import matrix, usable
from tidewire.session import cut

SCALE, EVERY, TOP, SLICES = 256, 50, 5, 2
#: Rows and queries of one block; blocks of small tables are smaller, so that there are some.
ROWS, QUERIES, LEAST_ROWS, BLOCKS = 65_536, 1024, 2048, 24
AT_ONCE, RESOLVED = 4096, 65_536


def _parts(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where these hold them exactly."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if bound < 2**52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return np.einsum("qd,rd->qr", queries, rows)


def _local_lists(width: int, most: int):
    """Of every query the ``most`` best parts in this block of rows."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, q_ids = rows.column("cid").to_numpy(), queries.column("qid").to_numpy()
        best = np.empty((len(q_ids), 0), dtype=np.int64)
        held = np.empty((len(q_ids), 0), dtype=np.int64)
        if len(q_ids) and len(ids):
            x, q = matrix(rows.column("part"), width, np.int64), matrix(queries.column("part"), width, np.int64)
            for at in range(0, len(ids), AT_ONCE):
                parts = np.concatenate([best, _parts(q, x[at : at + AT_ONCE])], axis=1)
                whose = np.concatenate([held, np.broadcast_to(ids[at : at + AT_ONCE], (len(q_ids), len(ids[at : at + AT_ONCE])))], axis=1)
                if parts.shape[1] > most:
                    where = np.argpartition(-parts, most - 1, axis=1)[:, :most]
                    parts, whose = np.take_along_axis(parts, where, 1), np.take_along_axis(whose, where, 1)
                best, held = parts, whose
        return pa.table({"qid": np.repeat(q_ids, best.shape[1]), "cid": held.ravel(), "part": best.ravel()})

    return run


def _reaching(width: int):
    """The entries that reach their query's cutoff."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, q_ids = rows.column("cid").to_numpy(), queries.column("qid").to_numpy()
        found = [(np.empty(0, dtype=np.int64),) * 2]
        if len(q_ids) and len(ids):
            x, q = matrix(rows.column("part"), width, np.int64), matrix(queries.column("part"), width, np.int64)
            cutoff = queries.column("cutoff").to_numpy()[:, None]
            for at in range(0, len(ids), AT_ONCE):
                i, j = np.nonzero(_parts(q, x[at : at + AT_ONCE]) >= cutoff)
                found.append((q_ids[i], ids[at + j]))
        listed = [np.concatenate([f[i] for f in found]) for i in (0, 1)]
        where = rows if rows.num_rows else queries
        return pa.table({
            "rows_block": where.column("rows_block")[:1], "queries_block": where.column("queries_block")[:1],
            "qids": pa.array([listed[0].astype("<i8").tobytes()]), "cids": pa.array([listed[1].astype("<i8").tobytes()]),
        }).slice(0, int(len(listed[0]) > 0))

    return run


def _resolve(width: int, most: int):
    """Whole scores of the entries between a block of rows and one of queries: those at or above the query's floor, and of
    them those that reach the block's ``most``-th best."""

    def run(entries: pa.Table, vectors: pa.Table) -> pa.Table:
        qids, cids = (
            np.concatenate([np.empty(0, dtype="<i8"), *(np.frombuffer(v.as_py(), "<i8") for v in entries.column(c))]) for c in ("qids", "cids")
        )
        asks = vectors.column("floor").is_valid().to_numpy(zero_copy_only=False)
        ids, v = vectors.column("id").to_numpy(), matrix(vectors.column("v"), width, np.int64)
        floors = vectors.column("floor").fill_null(0).to_numpy()
        q_at, c_at = _places(ids[asks], qids), _places(ids[~asks], cids)
        pair = np.unique(q_at * max(len(ids), 1) + c_at)
        q_at, c_at = pair // max(len(ids), 1), pair % max(len(ids), 1)
        q, x, floor = v[asks], v[~asks], floors[asks]
        scores = np.concatenate([np.empty(0, dtype=np.int64), *(
            np.einsum("nd,nd->n", q[q_at[at : at + RESOLVED]], x[c_at[at : at + RESOLVED]]) for at in range(0, len(pair), RESOLVED)
        )])
        # Pairs are in order of their query; within one the best come first.
        order = np.lexsort((-scores, q_at))
        q_at, c_at, scores = q_at[order], c_at[order], scores[order]
        first = np.searchsorted(q_at, q_at)
        last = np.minimum(first + most, np.searchsorted(q_at, q_at, side="right")) - 1
        kept = (scores >= floor[q_at]) & (scores >= scores[last]) if len(pair) else np.zeros(0, dtype=bool)
        return pa.table({"qid": ids[asks][q_at[kept]], "cid": ids[~asks][c_at[kept]], "score": scores[kept]})

    return run


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(ids)
    return order[np.searchsorted(ids[order], wanted)]


def _dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0)))
    return F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x)


def _resolved(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, cid, score): whole scores of the few pairs of the local lists."""
    wide = pairs.join(classes.select("cid", F.col("v").alias("xv")), "cid")
    wide = wide.join(queries.select(F.col("cid").alias("qid"), F.col("v").alias("qv")), "qid")
    return wide.select("qid", "cid", _dot("qv", "xv").alias("score"))


def search(vectors: DataFrame, is_query: Column, top: int = TOP, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` best other rows of every query row."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("e"), is_query.alias("query"))
    rows = rows.where(usable("e") & F.col("id").isNotNull())
    whole = F.transform("e", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    rows = cut(rows.select("id", "query", whole.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    want = top + 1  # a row's own class is among its best
    # Rank alone, so that copies are limited before the shuffle too; the class's number comes from its first row.
    same = Window.partitionBy("v").orderBy("id", "row")
    firsts = cut(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= want).select("id", "row", "v", "place"), "firsts")
    classes = cut(firsts.where("place = 1").select(F.col("row").alias("cid"), "v", F.col("id").alias("least")), "classes")
    members = firsts.join(classes.select("cid", "v"), "v").select("id", "row", "cid")
    asked = cut(rows.where("query").join(classes, "v").select("id", "row", "cid"), "asked")
    queries = cut(asked.select("cid").distinct().join(classes.select("cid", "v"), "cid"), "queries")

    sizes = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = sizes.n, max(sizes.width or 1, 1)
    row_blocks = max(1, -(-n // min(ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    step = -(-width // SLICES)

    def whole_dealt(table: DataFrame, own_block: str, own: int, other_block: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("cid", F.lit(own_block)), F.lit(own)).cast("int").alias(own_block)
        return table.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other_block))

    def dealt(table: DataFrame, *blocks) -> DataFrame:
        slices = F.array(*[
            F.struct(F.lit(s).alias("s"), F.slice("v", s * step + 1, step).alias("part")) for s in range(SLICES)
        ])
        return whole_dealt(table, *blocks).select("*", F.inline(slices)).drop("v")

    def visit(asked: DataFrame, step, schema: str) -> DataFrame:
        key = ["s", "rows_block", "queries_block"]
        left = dealt(classes.select("cid", "v"), "rows_block", row_blocks, "queries_block", query_blocks)
        right = dealt(asked, "queries_block", query_blocks, "rows_block", row_blocks).withColumnRenamed("cid", "qid")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(step, schema)

    lists = visit(queries, _with_slice(_local_lists(step, want)), "qid long, cid long, part long, s int")
    best = Window.partitionBy("qid", "s").orderBy(F.desc("part"), "cid")
    first = lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= want).select("qid", "cid").distinct()
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    floors = (
        _resolved(first, queries, classes).withColumn("place", F.row_number().over(by_score)).where(F.col("place") == want)
        .select(F.col("qid").alias("cid"), F.col("score").alias("floor"))
    )
    # Fewer than ``want`` candidates: no floor, so that every entry is sent.
    low = F.lit(-(2**63)).cast("long")
    armed = queries.join(floors, "cid", "left").select(
        "cid", "v", F.coalesce(F.ceil(F.col("floor") / SLICES).cast("long"), low).alias("cutoff"), F.coalesce("floor", low).alias("floor")
    )
    armed = cut(armed, "armed")
    entries = visit(
        armed.select("cid", "v", "cutoff"), _reaching(step), "rows_block int, queries_block int, qids binary, cids binary"
    )
    # Entries come back to the block of rows and the block of queries that they are of, where the whole vectors meet.
    sides = whole_dealt(classes.select("cid", "v", F.lit(None).cast("long").alias("floor")), "rows_block", row_blocks, "queries_block", query_blocks)
    sides = sides.unionByName(whole_dealt(armed.select("cid", "v", "floor"), "queries_block", query_blocks, "rows_block", row_blocks))
    block = ["rows_block", "queries_block"]
    scores = entries.groupBy(*block).cogroup(sides.withColumnRenamed("cid", "id").groupBy(*block)).applyInArrow(
        _resolve(width, want), "qid long, cid long, score long"
    )
    # The best classes of a query by their first row hold its best rows, as each has one of them at least.
    by_first = Window.partitionBy("qid").orderBy(F.desc("score"), "least", "cid")
    best_of = scores.join(classes.select("cid", "least"), "cid").withColumn("place", F.row_number().over(by_first)).where(F.col("place") <= want)
    scores = cut(best_of.select("qid", "cid", "score"), "scores")

    answers = asked.select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), F.col("cid").alias("qid")).join(scores, "qid")
    answers = answers.join(members.select("cid", F.col("id").alias("vec_id"), "row"), "cid").where("row <> query_row")
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    answers = answers.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return answers.select("query_id", "rank", "vec_id", "score")


def _with_slice(step):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = step(rows, queries)
        s = (rows if rows.num_rows else queries).column("s")[0].as_py()
        return found.append_column("s", pa.array(np.full(found.num_rows, s, dtype=np.int32)))

    return run
