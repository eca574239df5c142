"""The two vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.llm import cells, exact_search, neighbours

KIND = "vec_id bigint, embedding array<float>, label int, rank int, score double, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.0, 7) for i, v in rows], KIND)


def brute(ids, vectors, queries, k):
    found = []
    for q in queries:
        scores = [(-float(np.dot(vectors[q], vectors[i])), i) for i in ids if i != q]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return found


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    monkeypatch.setattr(exact_search, "CELL_ROWS", 64)


def exact(df, every, k=5):
    return exact_search.top_k(cells.usable(df), F.col("vec_id") % every == 0, k)


def whole(rng, count, width, span):
    return {i: rng.integers(-span, span, width).astype(float).tolist() for i in range(count)}


def test_exact_search_with_ties_and_a_hot_vector(spark, small_cells):
    rng = np.random.default_rng(1)
    vectors = whole(rng, 900, 6, 20)
    for i in range(0, 900, 3):  # a third of all rows are one vector
        vectors[i] = [3.0, 0.0, -2.0, 5.0, 1.0, 1.0]
    found = rows_of(exact(table(spark, vectors.items()), 50))
    assert found == brute(vectors, vectors, range(0, 900, 50), 5)


def test_exact_search_scans_less_than_everything(spark, small_cells):
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (12, 4))
    vectors = {i: (centres[i % 12] + rng.integers(-40, 40, 4)).astype(float).tolist() for i in range(1500)}
    df = table(spark, vectors.items())
    assert rows_of(exact(df, 50)) == brute(vectors, vectors, range(0, 1500, 50), 5)
    index = exact_search.build(cells.usable(df))
    queries = index.rows.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), "vector", F.lit(None).cast("double").alias("least")
    )
    near = exact_search._scan(exact_search._route(queries, index, True), index, 5)
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    asking = queries.drop("least").join(least.where("n = 5").drop("n"), "query_id", "left")
    routed = exact_search._route(asking, index, False).count()
    assert routed < 0.8 * queries.count() * len(index.bounds)


def test_exact_search_with_fewer_candidates_than_k(spark):
    vectors = {0: [1.0, 2.0], 50: [0.0, 0.0], 3: [-1.0, 4.0]}
    assert rows_of(exact(table(spark, vectors.items()), 50)) == brute(vectors, vectors, [0, 50], 5)


def test_whole_number_products_beyond_doubles():
    a = np.array([[2.0**28, 3.0]])
    b = np.array([[2.0**27, 1.0], [-(2.0**27), 5.0]])
    assert exact_search._products(a, b).tolist() == [[2.0**55 + 3, -(2.0**55) + 15]]


def test_rows_that_cannot_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [3.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (50, [0.0, 0.0]), (5, [3.0, 1.0]),
    ]
    df = table(spark, rows)
    assert sorted(r.vec_id for r in cells.usable(df).collect()) == [0, 5, 50]
    assert sorted(r.vec_id for r in cells.usable(df, zero=False).collect()) == [0, 5]
    assert rows_of(exact(df, 50)) == [(0, 1, 5, 5), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 5, 0)]


def test_empty_tables(spark):
    df = table(spark, [])
    assert exact(df, 1).collect() == []
    assert neighbours.nearest(cells.usable(df, zero=False), F.lit(True)).collect() == []


def test_neighbours_of_a_small_table_are_all_found(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.standard_normal(24).astype(np.float32).tolist() for i in range(700)}
    df = cells.usable(table(spark, vectors.items()), zero=False)
    found = rows_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20))
    wanted = brute(vectors, vectors, range(0, 700, 20), 20)
    hits = len({x[:1] + x[2:3] for x in found} & {x[:1] + x[2:3] for x in wanted})
    assert len(found) == len(wanted) and hits >= 0.95 * len(wanted)
    scores = {(q, i): s for q, _, i, s in found}
    assert all(s == pytest.approx(np.dot(vectors[q], vectors[i])) for (q, i), s in scores.items())


def test_recall_with_probed_lists_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 512)
    monkeypatch.setattr(cells, "CELL_ROWS", 128)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 128)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 32))
    vectors = {
        i: (centres[i % 30] + 0.4 * rng.standard_normal(32)).astype(np.float32).tolist()
        for i in range(3000)
    }
    for i in range(0, 3000, 3):
        vectors[i] = vectors[0]
    df = cells.usable(table(spark, vectors.items()), zero=False)
    index = neighbours.build(df, 10)
    assert index.probes < len(index.centres)
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 10).collect()
    wanted = {}
    for q, _, i, s in brute(vectors, vectors, range(0, 3000, 20), 10):
        wanted.setdefault(q, []).append(s)
    hits = sum(r.score >= wanted[r.query_id][-1] - 1e-5 for r in found)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_candidates_are_abandoned():
    rng = np.random.default_rng(8)
    held = rng.standard_normal((2000, 64))
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    asked = held[:20] + 0.05 * rng.standard_normal((20, 64))
    rotation = np.linalg.qr(rng.standard_normal((65, 65)))[0]
    scores = neighbours.dimension_scan(asked, held, rotation, 1.0, np.full(20, 0.8))
    assert np.isnan(scores).mean() > 0.8
    exact_scores = asked @ held.T
    near = exact_scores >= 0.8
    assert np.allclose(scores[near], exact_scores[near])


def test_every_query_gets_its_rows_where_few_lists_are_probed(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 24))
    count = 6000  # more than the sample
    vectors = {i: (centres[i % 60] + 0.3 * rng.standard_normal(24)).astype(np.float32).tolist() for i in range(count)}
    df = cells.usable(table(spark, vectors.items()), zero=False)
    index = neighbours.build(df, 20)
    assert count > neighbours.SAMPLE_ROWS == len(index.sample_ids) and index.probes < len(index.centres)
    found = neighbours.nearest(df, F.col("vec_id") % 40 == 0, 20).collect()
    assert len(found) == 20 * count // 40
    assert {(r.query_id, r.rank) for r in found} == {(q, k) for q in range(0, count, 40) for k in range(1, 21)}
    held = np.array([vectors[i] for i in range(count)], float)
    scores = held[::40] @ held.T
    scores[np.arange(count // 40), np.arange(0, count, 40)] = -np.inf
    least = np.sort(scores, axis=1)[:, -20]
    assert np.mean([r.score >= least[r.query_id // 40] - 1e-5 for r in found]) >= 0.9
