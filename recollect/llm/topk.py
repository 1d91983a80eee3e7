"""Operator 7: exact top-k by inner product, with the threshold algorithm.

Rows are gathered into blocks of at most `BLOCK` vectors; queries likewise.  Each block of queries meets each block of rows,
never a query each row of a table: what moves are whole blocks.  Within a block every dimension has its values sorted.  The
algorithm reads these lists in parallel, from the top where a query's weight is positive and from the bottom where it
is negative, scores each row when it first turns up, and after each round compares the k-th best score of a query with
its threshold: the score of a row that had, in every dimension, the value just read.  No row still unseen
can score more, so a query whose threshold is below its k-th score is done with the block.  The k best of a query
are carried from block to block within a task, so later blocks stop sooner.

Lists are read for a whole block of queries at once: a round scores all rows that have turned up in either
direction of any dimension.  That is more than the algorithm asks for one query and never less, so the bound holds.

Results for odd input: vectors that are null or empty or hold a null, an infinity or not-a-number take no part, nor do rows
with a null id; rows of equal vectors tie, and the smaller id comes first; rows that repeat an id are candidates each, but never for
that id; vectors of different lengths don't meet; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096
#: Blocks of rows that a task meets with one block of queries.
SLICE = 8
#: The score of a place that is not filled yet.
NONE = -(2**62)
_BLOCKS = "dim int, number long, ids binary, values binary"


def blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """vec_id and v (array of long) as blocks: ids are little-endian longs, values too or of 16 bits where that is enough; rows ascend by id."""

    def run(batches):
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def out(dim):
            nonlocal number
            ids = np.array([x[0] for x in held[dim]], "<i8")
            values = np.stack([x[1] for x in held[dim]]).astype("<i8")
            if np.abs(values).max(initial=0) < 2**15:
                values = values.astype("<i2")
            order = ids.argsort(kind="stable")
            held[dim] = []
            number += 1
            return pa.RecordBatch.from_pylist([{"dim": dim, "number": number, "ids": ids[order].tobytes(), "values": values[order].tobytes()}], schema)

        schema = pa.schema([("dim", pa.int32()), ("number", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())])
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                held.setdefault(int(b - a), []).append((i, values[a:b]))
                if len(held[b - a]) == size:
                    yield out(int(b - a))
        for dim in [d for d, x in held.items() if x]:
            yield out(dim)

    return df.select("vec_id", "v").mapInArrow(run, _BLOCKS)


def lists_of(values: np.ndarray) -> np.ndarray:
    """The sorted list of each dimension: numbers of the rows, ascending by value."""
    return values.argsort(axis=0, kind="stable")


def search(query_ids, queries, row_ids, rows, best, k: int, first: int = 16) -> int:
    """Improves `best`, (scores, ids) of shape (queries, k), by the rows of a block; returns how many rows were scored, over all queries.

    Unused places of `best` have NONE as score.  Rows ascend by id.
    """
    n, m = len(queries), len(rows)
    exact = float(np.abs(queries.astype(np.int64)).max(initial=0)) * float(np.abs(rows.astype(np.int64)).max(initial=0)) * rows.shape[1] < 2**52
    kind = np.float64 if exact else np.int64
    q, r = queries.astype(kind), rows.astype(kind)
    order = lists_of(rows)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    seen = np.zeros(m, bool)
    live = np.arange(n)
    scored, depth, step = 0, 0, first
    scores, ids = best
    while depth < m and len(live):
        end = min(m, depth + step)
        found = np.unique(np.concatenate([order[depth:end].ravel(), order[m - end : m - depth].ravel()]))
        found = found[~seen[found]]
        seen[found] = True
        if len(found):
            scored += len(found) * len(live)
            score = (q[live] @ r[found].T).astype(np.int64)
            own = query_ids[live][:, None] == row_ids[found][None]
            score[own] = NONE
            if len(found) > k:  # the best k of this round, smaller ids first among equals
                rank = score if np.abs(score[~own]).max(initial=0) > 2**48 else None
                if rank is None:
                    keyed = np.where(own, NONE, score * len(found) + np.arange(len(found))[::-1][None])
                    top = np.argpartition(-keyed, k - 1, axis=1)[:, :k]
                else:
                    top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
                score, which = np.take_along_axis(score, top, 1), row_ids[found][top]
            else:
                which = np.broadcast_to(row_ids[found][None], score.shape)
            score, which = np.concatenate([scores[live], score], 1), np.concatenate([ids[live], which], 1)
            take = np.lexsort((which, -score), axis=1)[:, :k]
            scores[live], ids[live] = np.take_along_axis(score, take, 1), np.take_along_axis(which, take, 1)
        depth, step = end, step * 2
        last = np.arange(r.shape[1])
        bound = up[live] @ r[order[m - end], last] + down[live] @ r[order[end - 1], last]
        live = live[bound >= scores[live][:, -1]]  # an equal score could still have a smaller id
    return scored


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, per_block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of greatest inner product for each query but its own.  Both have vec_id and v (array of long)."""
    q = written(blocks(queries, per_block), "query-blocks")
    r = written(blocks(rows, per_block), "row-blocks")
    # The numbers of the query blocks, one row for `per_block` queries; each is given its rows by a join on its number.
    numbers = q.select("dim", F.col("number").alias("q"))
    slices = r.withColumn("slice", F.floor(F.row_number().over(Window.partitionBy("dim", F.shiftright("number", 32)).orderBy("number")) / F.lit(SLICE)))
    slices = slices.withColumn("slice", F.struct(F.shiftright("number", 32), "slice"))
    met = slices.join(numbers, "dim").join(q.select(F.col("number").alias("q"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")), "q")

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for x in range(batch.num_rows):
                row = {c: batch.column(c)[x] for c in batch.schema.names}
                dim = row["dim"].as_py()
                array = lambda c: np.frombuffer(row[c].as_buffer(), "<i8")

                def matrix(c, n):
                    data = row[c].as_buffer()
                    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim)

                ids = array("ids")
                values = matrix("values", len(ids))
                query = row["q"].as_py()
                if query not in held:
                    if held:
                        yield out(*held.popitem()[1])
                    q_ids = array("q_ids").copy()
                    best = np.full((len(q_ids), k), NONE), np.full((len(q_ids), k), np.iinfo(np.int64).max)
                    held[query] = [q_ids, matrix("q_values", len(q_ids)).copy(), best]
                q_ids, q_values, best = held[query]
                search(q_ids, q_values, ids, values, best, k)
        if held:
            yield out(*held.popitem()[1])

    def out(q_ids, _, best):
        on = best[0] > NONE
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, on.sum(axis=1))), pa.array(best[1][on]), pa.array(best[0][on])], ["query_id", "vec_id", "score"])

    found = met.repartition("q", "slice").sortWithinPartitions("q").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x; only rows whose components are all finite numbers."""

    def odd(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    fit = F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)
    return df.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.filter(F.col("vec_id") % 20 == 0), rows, 20)


OP7_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
