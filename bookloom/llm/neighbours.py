"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are rotated at random, so that any prefix of their components estimates a distance. In
each probed list the columns are read in blocks; after a block, a candidate whose partial
distance is too large for the whole one to fall below the threshold, at the confidence that
``EPSILON`` states, is abandoned. Survivors are scored exactly on the original vectors.
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
    squared_norm,
)

SAMPLE_ROWS = 4096  # the lists, the number of probes and first thresholds are fitted on these
MAX_LISTS = 1024
COLUMNS = 16  # read before each test
EPSILON = 2.1  # in units of the standard error of a partial distance
TARGET_RECALL = 0.97  # of the probes, on the sample
_FOUND = "query_id bigint, vec_id bigint, score double"


class Index(NamedTuple):
    """A staged index of all rows, and its small fitted parts."""

    rows: DataFrame  # vec_id, vector, list, part
    lists: DataFrame  # list, parts
    centres: np.ndarray  # lifted
    rotation: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    probes: int
    largest: float


def _centres(points: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = points[rng.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=count)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def _asking(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.zeros((len(vectors), 1))])


def _probes(sample: np.ndarray, points: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many lists hold ``TARGET_RECALL`` of the neighbours of up to 512 rows of the sample."""
    asking = sample[:512]
    scores = asking @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = distances(points, centres).argmin(1)
    order = distances(_asking(asking), centres).argsort(1).argsort(1)
    places = np.take_along_axis(order, home[best], axis=1)
    return int(np.quantile(places, TARGET_RECALL, method="higher")) + 1


def build(vectors: DataFrame, k: int = 20) -> Index | None:
    """Index ``vec_id, vector`` (see ``cells.usable``); None for an empty table.

    Lists and probes are fitted on at most ``SAMPLE_ROWS`` rows; every row is indexed. A list of
    many rows is cut into parts, all of which its queries scan.
    """
    vectors = stage(vectors, "vectors")
    total, largest = vectors.agg(F.count("*"), F.max(squared_norm("vector"))).first()
    if not total:
        return None
    ids, sample = bounded_sample(vectors, total, SAMPLE_ROWS)
    points = lifted(sample, largest)
    distinct = np.unique(points, axis=0)
    count = int(np.clip(total // CELL_ROWS, 8, min(MAX_LISTS, SAMPLE_ROWS // 8)))
    centres = _centres(distinct, min(count, len(distinct)))
    rotation = np.linalg.qr(
        np.random.default_rng(5).standard_normal((points.shape[1], points.shape[1]))
    )[0]

    def assign(batches):
        for batch in batches:
            if len(batch):
                near = distances(lifted(matrix(batch), largest), centres).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["vector"], pa.array(near.astype(np.int32))],
                    ["vec_id", "vector", "list"],
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    listed = stage(vectors.mapInArrow(assign, f"vec_id bigint, vector {kind}, list int"), "listed")
    rows, lists = split_cells(listed, ["list"])
    probes = _probes(sample, points, centres, k)
    return Index(stage(rows, "index"), lists, centres, rotation, ids, sample, probes, largest)


def _route(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, vector, least, list``: the probed lists, nearest first, and a threshold.

    The threshold is the k-th best score among the sample, which is part of the table.
    """
    centres, probes = index.centres, index.probes
    sample_ids, sample = index.sample_ids, index.sample

    def route(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                vectors = matrix(part)
                near = distances(_asking(vectors), centres).argsort(1)[:, :probes]
                scores = vectors @ sample.T
                scores[part["query_id"].to_numpy()[:, None] == sample_ids[None, :]] = -np.inf
                least = np.full(len(part), -np.inf)
                if scores.shape[1] > k:
                    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                times = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [*part.select(["query_id", "vector"]).take(times).columns,
                     pa.array(np.repeat(least, near.shape[1])),
                     pa.array(near.ravel().astype(np.int32))],
                    ["query_id", "vector", "least", "list"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(route, f"query_id bigint, vector {kind}, least double, list int")


def _sampled(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of the sample for each query.

    These are rows of the table that have been scored for the threshold; the lists that they are in
    need not be probed, and a scan that looks for better ones only need not find them again.
    """
    ids, sample = index.sample_ids, index.sample

    def best(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                vectors, own = matrix(part), part["query_id"].to_numpy()
                rows, cols = best_of_rows(vectors @ sample.T, own, ids, np.full(len(own), -np.inf), k)
                scores = np.einsum("ij,ij->i", vectors[rows], sample[cols])
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(ids[cols]), pa.array(scores)], ["query_id", "vec_id", "score"])

    return queries.mapInArrow(best, _FOUND)


def dimension_scan(
    asked: np.ndarray, held: np.ndarray, rotation: np.ndarray, largest: float, least: np.ndarray
) -> np.ndarray:
    """Scores of all pairs whose partial distances were never too large; NaN for the others.

    ``least`` is a score for each query; a pair that falls below it need not be found.
    """
    dims = len(rotation)
    turned, members = _asking(asked) @ rotation, lifted(held, largest) @ rotation
    squares = np.einsum("ij,ij->i", asked, asked)
    limit = squares + largest - 2.0 * least + 1e-9 * largest  # of the squared distance
    partial = np.zeros((len(asked), len(held)))
    alive_q, alive_m = None, None
    for start in range(0, dims, COLUMNS):
        a, b = turned[:, start : start + COLUMNS], members[:, start : start + COLUMNS]
        seen = min(start + COLUMNS, dims)
        if alive_q is None:
            partial += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        else:
            difference = a[alive_q] - b[alive_m]
            partial[alive_q, alive_m] += np.einsum("ij,ij->i", difference, difference)
        if seen < dims:
            room = (1.0 + EPSILON / np.sqrt(seen)) ** 2 * seen / dims
            if alive_q is None:
                keep = partial <= (limit * room)[:, None]
                if keep.mean() < 0.25:  # from here on, pair by pair
                    alive_q, alive_m = np.nonzero(keep)
            else:
                keep = partial[alive_q, alive_m] <= limit[alive_q] * room
                alive_q, alive_m = alive_q[keep], alive_m[keep]
    if alive_q is None:
        return asked @ held.T
    scores = np.full(partial.shape, np.nan)
    scores[alive_q, alive_m] = np.einsum("ij,ij->i", asked[alive_q], held[alive_m])
    return scores


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query.

    ``vectors`` is ``vec_id, vector`` (see ``cells.usable``, without zero vectors), ``is_query``
    selects the queries by ``vec_id``; candidates are all rows but the query's own. Scores are
    exact, in double precision; ties go to the smaller id. Every query gets ``k`` rows, or all
    candidates if there are fewer: the sample, which holds more than that, is scored whole. An
    empty table gives no rows.
    """
    index = build(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double"
        )
    queries = index.rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = (
        _route(queries, index, k).join(F.broadcast(index.lists), "list").withColumn("part", parts)
    )
    rotation, largest = index.rotation, index.largest

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        least = asked["least"].to_numpy().astype(np.float64)
        asking, vectors = matrix(asked), matrix(held)
        rows, cols, scores = [], [], []
        for at in range(0, len(own), 256):
            block = slice(at, at + 256)
            found = dimension_scan(asking[block], vectors, rotation, largest, least[block])
            found = np.where(np.isnan(found), -np.inf, found)
            # A matrix product and a sum can differ in the last places.
            i, j = best_of_rows(found, own[block], ids, least[block] - 1e-9 * largest, k)
            rows.append(i + at)
            cols.append(j)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        scores = np.einsum("ij,ij->i", asking[rows], vectors[cols])
        return pa.table({"query_id": own[rows], "vec_id": ids[cols], "score": scores})

    found = meet(asked.drop("parts"), index.rows, ["list", "part"], scan, _FOUND)
    # The same pair has the same score from either side.
    both = found.unionByName(_sampled(queries, index, k))
    found = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
