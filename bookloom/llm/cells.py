"""Vectors in cells of bounded size, and queries that meet the cells they are routed to.

Shared by the two vector searches. Inner products become distances by one more component: with
``M`` the largest norm, ``x' = (x, sqrt(M² - |x|²))`` and ``q' = (q, 0)`` give
``|q' - x'|² = |q|² + M² - 2 q·x``, so the largest inner product is the smallest distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 2048  # rows of a cell, and queries of a block, about


def usable(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True
) -> DataFrame:
    """``vec_id, vector``: the rows that can take part in a search.

    Left out: null ids; vectors that are null, empty, hold null or non-finite components, or
    (unless ``zero``) are all zero; vectors whose length is not the most frequent one (of equally
    frequent lengths the larger). Rows that repeat an id count once, with the smallest vector.
    An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", number)
    )
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    rows = rows.where(F.size("vector") == length)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def squared_norm(vector: str | Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def matrix(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """The vectors of an Arrow table as rows of a matrix of doubles."""
    column = table[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(table), -1) if len(table) else values.reshape(0, 0)


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """The vectors with the component that makes all norms ``largest`` (a square)."""
    rest = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.hstack([vectors, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def bounded_sample(rows: DataFrame, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows, those of the smallest hashes."""
    share = min(1.0, 2.0 * most / max(total, 1))
    order = F.xxhash64("vec_id", F.lit(7))
    picked = rows.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found = picked.orderBy(order, "vec_id").limit(most).toArrow()
    return found["vec_id"].to_numpy(), matrix(found)


def split_cells(index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut every group of ``keys`` into parts of about ``CELL_ROWS`` rows by a hash of the id.

    Returns the rows with ``part``, and one row per group with ``parts``. A group that holds a
    third of all rows, even of equal vectors, becomes many cells.
    """
    groups = index.groupBy(*keys).agg(
        F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")
    )
    # One row for each group; the number of groups is bounded by the callers.
    rows = index.join(F.broadcast(groups), keys)
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")
    return rows.withColumn("part", part).drop("parts"), groups


def meet(
    queries: DataFrame,
    members: DataFrame,
    keys: list[str],
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Run ``kernel(queries, members)`` for every cell that queries are routed to.

    ``queries`` holds a row for each query and cell, ``members`` the rows of the cells. The
    queries of a cell are cut into blocks of about ``CELL_ROWS``, each of which gets the
    cell's rows, so that a task holds two blocks whatever the number of queries to a cell.
    """
    blocks = queries.groupBy(*keys).agg(
        F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks")
    )
    # One row for each cell; the number of cells is bounded by the callers.
    left = queries.join(F.broadcast(blocks), keys).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    )
    right = members.join(F.broadcast(blocks), keys).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    key = [*keys, "block"]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        return kernel(asked, held)

    return (
        left.drop("blocks").groupBy(*key).cogroup(right.drop("blocks").groupBy(*key))
        .applyInArrow(run, schema)
    )


def best_of_rows(
    scores: np.ndarray, own: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` best of every row: largest score, then smallest id.

    Left out are scores under ``least``, NaN, and the column whose id is the row's ``own``.
    """
    by_id = np.argsort(ids, kind="stable")
    scores = np.where(ids[None, by_id] == own[:, None], -np.inf, scores[:, by_id])
    scores = np.where(scores >= least[:, None], scores, -np.inf)
    rows, cols = [], []
    if scores.shape[1] > 4 * k:
        # Only scores that reach the k-th of their row can be among its k best, ties included.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        kth = np.full(len(scores), -np.inf)
    for i in range(len(scores)):
        places = np.flatnonzero((scores[i] >= kth[i]) & (scores[i] > -np.inf))
        places = places[np.argsort(-scores[i, places], kind="stable")[:k]]
        rows.append(np.full(len(places), i))
        cols.append(by_id[places])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)
