"""Exact search for the largest inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to that pivot, and the sorted
distances of a pivot are cut into annuli. A query first scans the annulus it falls into; its
k-th best score so far is a radius, and the triangle inequality rules out every annulus, and
every row of an annulus, whose distance to the pivot differs from the query's by more than it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.staging import stage
from .cells import (
    CELL_ROWS, best_of_rows, bounded_sample, distances, lifted, matrix, meet, split_cells,
    squared_norm, usable,
)

MAX_PIVOTS = 64
MAX_ANNULI = 65_536  # of all pivots; their bounds are a table of at most some MB
_FOUND = "query_id bigint, vec_id bigint, score double"
_EXACT = 2.0**53


class Index(NamedTuple):
    """A staged index: rows in cells, and what routing needs to know of them."""

    rows: DataFrame  # vec_id, vector, distance, annulus, part
    annuli: DataFrame  # annulus, parts
    pivots: np.ndarray  # lifted
    bounds: np.ndarray  # for each annulus: pivot, smallest and largest distance
    largest: float  # squared norm


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where they hold every partial sum."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < _EXACT:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def build(vectors: DataFrame) -> Index | None:
    """Index ``vec_id, vector`` (see ``cells.usable``); None for an empty table.

    Pivots are rows of the table, at most ``MAX_PIVOTS``; every row is indexed. The number of
    annuli of a pivot follows the number of rows, up to ``MAX_ANNULI`` in all.
    """
    vectors = stage(vectors, "vectors")
    total, largest = vectors.agg(F.count("*"), F.max(squared_norm("vector"))).first()
    if not total:
        return None
    count = int(np.clip(np.sqrt(total) / 8, 1, MAX_PIVOTS))
    pivots = lifted(np.unique(bounded_sample(vectors, total, count)[1], axis=0), largest)

    def key(batches):
        for batch in batches:
            if len(batch):
                away = distances(lifted(matrix(batch), largest), pivots)
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["vector"], pa.array(near.astype(np.int32)),
                     pa.array(away[np.arange(len(near)), near])],
                    ["vec_id", "vector", "pivot", "distance"],
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    keyed = stage(
        vectors.mapInArrow(key, f"vec_id bigint, vector {kind}, pivot int, distance double"),
        "keyed",
    )
    each = int(np.clip(np.ceil(total / len(pivots) / CELL_ROWS), 1, MAX_ANNULI // len(pivots)))
    cuts = F.percentile_approx("distance", [i / each for i in range(1, each)] or [1.0], 10_000)
    edges = keyed.groupBy("pivot").agg(cuts.alias("edges"))  # a row for each pivot
    ring = F.size(F.filter("edges", lambda edge: edge < F.col("distance")))
    placed = keyed.join(F.broadcast(edges), "pivot").select(
        "vec_id", "vector", "distance", (F.col("pivot") * (each + 1) + ring).alias("annulus")
    )
    rows, annuli = split_cells(placed, ["annulus"])
    rows = stage(rows, "index")
    found = rows.groupBy("annulus").agg(F.min("distance"), F.max("distance")).toArrow()
    bounds = np.column_stack([column.to_numpy().astype(np.float64) for column in found])
    bounds = np.column_stack([bounds[:, 0] // (each + 1), bounds[:, 1:], bounds[:, 0]])
    return Index(rows, annuli, pivots, bounds, largest)


def _route(queries: DataFrame, index: Index, home: bool) -> DataFrame:
    """``query_id, vector, least, annulus``: the annuli that a query has to scan.

    ``home``: the one nearest to the query. Else all others that may hold a score of ``least``
    or more; a query without ``least`` scans them all.
    """
    pivots, bounds, largest = index.pivots, index.bounds, index.largest

    def route(batches):
        pivot = bounds[:, 0].astype(int)
        for batch in batches:
            if not len(batch):
                continue
            vectors = matrix(batch)
            squares = np.einsum("ij,ij->i", vectors, vectors)
            away = distances(np.hstack([vectors, np.zeros((len(vectors), 1))]), pivots)[:, pivot]
            gap = np.maximum(np.maximum(bounds[:, 1] - away, away - bounds[:, 2]), 0.0)
            first = (gap + 1e-9 * away).argmin(1)
            if home:
                rows, cols = np.arange(len(first)), first
            else:
                least = batch["least"].to_numpy(zero_copy_only=False).astype(np.float64)
                radius = np.sqrt(np.maximum(squares + largest - 2 * least, 0.0))
                radius = np.where(np.isnan(least), np.inf, radius)
                open_ = gap <= (radius + _slack(largest, squares))[:, None]
                open_[np.arange(len(first)), first] = False
                rows, cols = np.nonzero(open_)
            for at in range(0, len(rows), 4096):  # copies of the vectors stay few at a time
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["query_id", "vector", "least"]).take(pa.array(part)).columns,
                     pa.array(bounds[cols[at : at + 4096], 3].astype(np.int32))],
                    ["query_id", "vector", "least", "annulus"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(
        route, f"query_id bigint, vector {kind}, least double, annulus int"
    )


def _slack(largest: float, squares: np.ndarray) -> np.ndarray:
    """What rounding can add to a distance, with room to spare."""
    return 1e-6 * (1.0 + np.sqrt(largest) + np.sqrt(squares))


def _scan(queries: DataFrame, index: Index, k: int) -> DataFrame:
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = queries.join(F.broadcast(index.annuli), "annulus").withColumn("part", parts)

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        least = asked["least"].to_numpy().astype(np.float64)
        least = np.where(np.isnan(least), -np.inf, least)
        rows, cols, scores = [], [], []
        vectors, asking = matrix(held), matrix(asked)
        for at in range(0, len(own), 256):
            block = slice(at, at + 256)
            found = _products(asking[block], vectors)
            i, j = best_of_rows(found, own[block], ids, least[block], k)
            rows.append(i + at)
            cols.append(j)
            scores.append(found[i, j])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pa.table(
            {"query_id": own[rows], "vec_id": ids[cols], "score": np.concatenate(scores)}
        )

    return meet(asked.drop("parts"), index.rows, ["annulus", "part"], scan, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products, exactly.

    ``vectors`` (``vec_id, vector``, see ``cells.usable``) holds whole numbers; ``is_query``
    selects the queries by ``vec_id``. Candidates are all rows but the query's own; with fewer
    than ``k`` of them all are returned. Ties go to the smaller id. Inner products have to stay
    under 2^53. An empty table gives no rows.
    """
    index = build(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score bigint"
        )
    queries = index.rows.where(is_query).select(
        F.col("vec_id").alias("query_id"), "vector", F.lit(None).cast("double").alias("least")
    )
    near = stage(_scan(_route(queries, index, home=True), index, k), "near")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("place", F.row_number().over(by_score))
    least = ranked.where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    asking = queries.drop("least").join(least, "query_id", "left")
    far = _scan(_route(asking, index, home=False), index, k)
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))
    )
