"""Exact top-k by inner product: the threshold algorithm over sorted lists per dimension.

All rows are dealt into blocks.  A block keeps its vectors and, for every dimension,
its rows sorted by that component; the blocks are a stored table.  A query reads the
lists of its components from their better ends, a step of all lists at a time, scores
what it has not seen yet, and stops when not even a row with the components at the
places reached could be among its best.  Queries meet blocks in cells of
bounded size, first one block each, whose k-th score then bounds all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.llm.common import stored, tidied_group

BLOCK_VALUES = 1 << 19  # components of a block: 8,192 rows of 64
CHUNK_VALUES = 1 << 17  # components of the queries of a cell
FIRST_STEP, LAST_STEP = 8, 512  # places of every list read at once
_CELL = "qkey long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null where the vector or a component is null or not finite."""
    values = vector.cast("array<double>")
    good = F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(good, F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _lists(group: pa.Table) -> pa.Table:
    """One block: ids in ascending order, vectors, and the rows of each dimension by ascending component."""
    dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    ids = group.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = _matrix(group.column("v"), dim)[order]
    lists = np.argsort(vectors.T, axis=1, kind="stable").astype(np.int32)
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids[order], vectors, lists)]
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "ids": blobs[0], "vectors": blobs[1], "lists": blobs[2]})


def threshold_search(query: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best rows, ties to the smaller row, and the number of rows scored.

    With a ``bound`` rows that score less may be left out.
    """
    n = len(vectors)
    used = np.flatnonzero(query)
    weight = query[used]
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, FIRST_STEP
    while at < n:
        end = min(at + step, n)
        if len(used):
            up = lists[used[weight < 0], at:end]
            down = lists[used[weight > 0], n - end : n - at]
            seen_now = np.concatenate([up.ravel(), down.ravel()])
        else:  # every row scores 0
            end = n
            seen_now = np.arange(n)
        fresh = np.unique(seen_now[~seen[seen_now]])
        seen[fresh] = True
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, vectors[fresh] @ query])
        if len(rows) > k:
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
        if end == n:
            break
        # What no list has shown yet has at most the components at the places reached.
        reached = np.where(weight < 0, lists[used, end - 1], lists[used, n - end])
        most = int(vectors[reached, used] @ weight)
        # A row that scores as much as the k-th may still come before it.
        if (len(rows) == k and scores.min() > most) or (bound is not None and bound > most):
            break
        at, step = end, min(step * 2, LAST_STEP)
    order = np.lexsort((rows, -scores))
    rows, scores = rows[order], scores[order]
    if bound is not None:
        rows, scores = rows[scores >= bound], scores[scores >= bound]
    return rows, scores, int(seen.sum())


def _searched(index: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """qkey, vec_id, score: the k best of every query in every cell where it meets a block."""

    def cell(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and asked.num_rows:
            dim = block.column("dim")[0].as_py()
            ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
            vectors = np.frombuffer(block.column("vectors")[0].as_py(), np.int64).reshape(len(ids), dim)
            lists = np.frombuffer(block.column("lists")[0].as_py(), np.int32).reshape(dim, len(ids))
            values = _matrix(asked.column("v"), dim)
            for query, key, bound in zip(values, asked.column("qkey").to_pylist(), asked.column("bound").to_pylist()):
                rows, scores, _ = threshold_search(query, vectors, lists, k, bound)
                out.append((np.full(len(rows), key), ids[rows], scores))
        parts = zip(*out) if out else ([np.zeros(0, np.int64)],) * 3
        return pa.table(dict(zip(("qkey", "vec_id", "score"), (np.concatenate(p) for p in parts))))

    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(tidied_group(cell), _CELL)


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_inner_products(vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024, block_values: int = BLOCK_VALUES, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product for each row that is ``asked``.

    Components become floor(scale * x); scores are whole numbers of 64 bits.  A query
    is compared with all rows but itself, ties go to the smaller vec_id.  Rows without
    an id, null vectors and those with null or non-finite components take no part;
    vectors of different sizes are not compared.  Rows that repeat an id are all
    compared; each that is asked has its own answer.  Empty tables give empty
    ones; other columns are ignored.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v"), asked.alias("asked"))
    # The number of a row deals rows out evenly, whatever they hold.
    rows = whole.where("vec_id is not null and v is not null").withColumn("dim", F.size("v")).withColumn("deal", F.monotonically_increasing_id())
    rows = stored(rows, "whole_vectors")
    values, asked_values = rows.agg(F.coalesce(F.sum(F.col("dim") + 1), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked"), F.col("dim") + 1)), F.lit(0))).first()
    blocks, chunks = max(1, -(-values // block_values)), max(1, -(-asked_values // chunk_values))
    placed = rows.select("dim", F.pmod(F.xxhash64("deal"), F.lit(blocks)).alias("block"), "vec_id", "v")
    index = stored(placed.groupBy("dim", "block").applyInArrow(tidied_group(_lists), "dim int, block long, ids binary, vectors binary, lists binary"), "sorted_lists")

    # Equal rows ask once and are answered as often as they stand there.
    distinct = rows.where("asked").groupBy("vec_id", "dim", "v").agg(F.count("*").alias("times"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    queries = stored(distinct.withColumn("qkey", F.monotonically_increasing_id()).withColumn("own", own).withColumn("chunk", F.pmod(F.xxhash64("qkey"), F.lit(chunks))), "queries")

    keys = ["dim", "block", "chunk"]
    asking = queries.select("qkey", "dim", "chunk", "v")
    home = asking.withColumns({"block": F.col("chunk") % blocks, "bound": F.lit(None).cast("long")})
    at_home = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"))).where(F.col("chunk") % blocks == F.col("block"))
    near = stored(_searched(at_home, home, keys, k + 1), "home_hits")
    bounds = near.groupBy("qkey").agg(F.count("*").alias("hits"), F.min("score").alias("least")).where(F.col("hits") == k + 1).select("qkey", F.col("least").alias("bound"))
    bounded = asking.join(bounds, "qkey", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    away = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"))).where(F.col("chunk") % blocks != F.col("block"))
    far = _searched(away, bounded.where(F.col("chunk") % blocks != F.col("block")), keys, k + 1)

    best = _first(near.unionByName(far), k + 1).join(queries.select("qkey", F.col("vec_id").alias("query_id"), "own", "times"), "qkey")
    # One row with the query's id and its product with itself is the query.
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("qkey"))
    ranked = best.withColumn("itself", itself).where("itself is null or place != itself")
    ranked = ranked.withColumn("rank", F.col("place") - F.when(F.col("place") > F.col("itself"), 1).otherwise(0)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
