import random
import time

import pytest

from bookloom.operators import influence, pairs


def brute_force(rows, years):
    return {
        (a, b) for a, x in rows for b, y in rows if a != b and abs(x - y) <= years
    }


def network_of(spark, rows, years=5):
    books = spark.createDataFrame(rows, "author string, release_year int")
    return influence.author_network(books, years)


def edges(df):
    found = [(r.author1, r.author2) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def degrees(df):
    return {r.author: r.degree for r in df.collect()}


def random_rows(seed, authors, books, first, last):
    rng = random.Random(seed)
    return [(f"A{rng.randrange(authors)}", rng.randint(first, last)) for _ in range(books)]


CASES = {
    "one year each": ([("a", 2000), ("b", 2005), ("c", 2006), ("d", 2011), ("e", 1900)], 5),
    "gap of eleven": ([("a", 2000), ("a", 2011), ("b", 2005), ("c", 2006), ("d", 1995)], 5),
    "gap of twelve": ([("a", 2000), ("a", 2012), ("b", 2006), ("c", 2007), ("d", 2005)], 5),
    "same author only": ([("a", 2000), ("a", 2001)], 5),
    "case matters": ([("a", 2000), ("A", 2000)], 5),
    "years of four odd digits": ([("a", 0), ("b", 4), ("c", 9999), ("d", 1234)], 5),
    "window of zero": ([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("a", 3), ("d", 4)], 0),
    "window of two": (random_rows(3, 25, 60, 1900, 1990), 2),
    "sparse": (random_rows(1, 30, 90, 1000, 2500), 5),
    "dense": (random_rows(2, 40, 150, 1900, 1960), 5),
}


@pytest.mark.parametrize("name", CASES)
def test_same_links_as_comparing_all_books(spark, name):
    rows, years = CASES[name]
    want = brute_force(rows, years)
    network = network_of(spark, rows, years)
    assert edges(influence.influence_edges(network)) == want
    out = degrees(influence.out_degree(network))
    assert out == {a: sum(1 for x, _ in want if x == a) for a in {a for a, _ in want}}
    assert influence.edge_count(network).first().total_edges == len(want)
    if len(rows) > 20:
        assert degrees(influence.in_degree(network)) == out
    sample = [tuple(r) for r in influence.edge_sample(network, 10).collect()]
    assert sample == sorted(want)[:10]


def test_profile_spans(spark):
    rows = [("a", 2000), ("a", 2011), ("a", 2011), ("a", 2023), ("b", 1999)]
    books = spark.createDataFrame(rows, "author string, release_year int")
    spans = influence.author_spans(books, 5).collect()
    found = {r.author: [tuple(s) for s in r.spans] for r in spans}
    assert found == {"a": [(2000, 2011), (2023, 2023)], "b": [(1999, 1999)]}


def test_a_third_of_the_authors_in_one_year(spark, monkeypatch):
    rows = [(f"H{i}", 2004) for i in range(60)] + random_rows(5, 60, 120, 1950, 2020)
    monkeypatch.setattr(influence, "blocks", lambda df: pairs.blocks(df, bits=3))  # 8 to a block
    network = network_of(spark, rows)
    want = brute_force(rows, 5)
    assert edges(influence.influence_edges(network)) == want
    assert influence.edge_count(network).first().total_edges == len(want)


def test_degrees_list_no_pairs_of_authors(spark):
    network = network_of(spark, [(f"H{i}", 2000 + i % 3) for i in range(3000)])
    top = influence.top_degree(influence.out_degree(network), 2)
    assert [tuple(r) for r in top.collect()] == [("H0", 2999), ("H1", 2999)]
    assert network.profiles.count() == 3


def test_no_authors(spark):
    network = network_of(spark, [])
    assert influence.edge_count(network).first().total_edges == 0
    assert influence.influence_edges(network).count() == 0
    assert influence.edge_sample(network).count() == 0


def test_points_that_dominate(spark):
    rng = random.Random(8)
    points = [(rng.randrange(-30, 30), rng.randrange(-30, 30), rng.randrange(1, 5)) for _ in range(200)]
    points += [(influence._BEFORE, 5, 2), (3, influence._AFTER, 7)]
    queries = [(i, rng.randrange(-30, 30), rng.randrange(-30, 30)) for i in range(60)]
    found = influence.dominated(
        spark.createDataFrame(points, "x int, y int, n bigint"),
        spark.createDataFrame(queries, "key bigint, x int, y int"),
    )
    want = {k: sum(n for px, py, n in points if px < x and py > y) for k, x, y in queries}
    assert {r.key: r.total for r in found.collect() if r.total} == {k: n for k, n in want.items() if n}


def test_thousands_of_authors_with_many_spans(spark, monkeypatch):
    rng = random.Random(11)
    met = []
    linked = influence.linked_profiles
    monkeypatch.setattr(influence, "linked_profiles", lambda a, b, y: met.append((a, b)) or linked(a, b, y))
    rows = []
    for i in range(2500):
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            rows.append((f"A{i}", rng.randrange(1500, 1800)))
    rows += [(f"H{i}", 1700) for i in range(900)]
    network = network_of(spark, rows)
    years = {}
    for author, year in rows:
        years.setdefault(author, set()).add(year)
    by_year = {}
    for author, own in years.items():
        for year in own:
            by_year.setdefault(year, set()).add(author)
    want = {}
    for author, own in years.items():
        near = set().union(*(by_year.get(y + d, ()) for y in own for d in range(-5, 6)))
        if len(near) > 1:
            want[author] = len(near) - 1
    assert degrees(influence.out_degree(network)) == want
    assert influence.edge_count(network).first().total_edges == sum(want.values())
    # Only profiles of several spans meet one by one.
    assert met and all(side.where("size(spans) = 1").count() == 0 for pair in met for side in pair)


def test_groups_of_sums_do_not_grow_with_the_profiles(spark):
    # 100,000 profiles of two spans and their gaps, over 320 years.
    books = spark.range(100_000).selectExpr("id as profile", "cast(1000 + id % 317 as int) as x", "cast(1400 + id div 317 as int) as y")
    points = books.selectExpr("x", "y", "1L as n")
    queries = books.selectExpr("profile as key", "x + 3 as x", "y - 3 as y")
    assert points.distinct().count() > 99_000
    odd = influence._below(queries.select("x", "y").distinct(), "y").where("block % 2 = 1")
    asked = odd.selectExpr("x", "y", "bit", "block - 1 as block")
    grid = influence.year_grid(points, asked)
    most = grid.groupBy("bit", "block").count().selectExpr("max(count)").first()[0]
    assert most <= 330
    plan = influence.dominated(points, queries)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [") :].splitlines()[1]
    assert "Aggregate" in window  # of the grid: one row for each year of a block
    some = influence.dominated(points, queries.where("key % 9973 = 0")).collect()
    held = [(1000 + i % 317, 1400 + i // 317) for i in range(100_000)]
    for r in some:
        x, y = held[r.key][0] + 3, held[r.key][1] - 3
        assert r.total == sum(a < x and b > y for a, b in held)


def test_a_sample_counts_no_degrees(spark, monkeypatch):
    monkeypatch.setattr(influence, "_profile_degrees", None)
    rows = [(f"A{i:05}", 1000 + 20 * (i % 400)) for i in range(200)] + [("Z1", 9000), ("Z2", 9003), ("Z3", 9003)]
    network = network_of(spark, rows)
    found = [tuple(r) for r in influence.edge_sample(network, 4).collect()]
    assert found == sorted(brute_force(rows, 5))[:4]  # only the last have links: probed again and again
    assert influence.authors_by_year(network).count() <= 10_000


def test_pairs_that_meet_in_several_years_come_once(spark):
    rng = random.Random(21)
    rows = [(f"A{i}", 1500 + 15 * rng.randrange(12)) for i in range(60) for _ in range(4)]
    network = network_of(spark, rows)
    links = influence.linked_profiles(network.profiles, network.profiles, 5)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [group_a" not in plan
    found = [tuple(r) for r in links.collect()]
    assert len(found) == len(set(found))
    some = network.profiles.where("profile % 2 = 0")
    part = [tuple(r) for r in influence.linked_profiles(some, network.profiles, 5).collect()]
    ids = {r.profile for r in some.collect()}
    assert sorted(part) == sorted(p for p in found if p[0] in ids)
    assert edges(influence.influence_edges(network)) == brute_force(rows, 5)


def test_authors_of_very_many_spans(spark, monkeypatch):
    monkeypatch.setattr(influence, "_PART_ROWS", 32, raising=False)  # several parts
    rng = random.Random(31)
    rows = {(f"A{i}", 1000 + 13 * rng.randrange(650) + i % 3) for i in range(70) for _ in range(180)}
    rows |= {(f"L{i}", rng.randrange(1000, 9999)) for i in range(30)} | {("Z", 30)}
    network = network_of(spark, sorted(rows))
    assert network.profiles.selectExpr("max(size(spans))").first()[0] > 130
    began = time.monotonic()
    found = [tuple(r) for r in influence.linked_profiles(network.profiles, network.profiles, 5).collect()]
    assert time.monotonic() - began < 30  # took minutes when each meeting carried the spans of both
    years = {r.profile: [tuple(s) for s in r.spans] for r in network.profiles.collect()}
    near = lambda x, y: any(f <= u + 5 and t <= l + 5 for f, l in x for t, u in y)
    assert sorted(found) == sorted((a, b) for a, x in years.items() for b, y in years.items() if near(x, y))
    want = brute_force(sorted(rows), 5)
    assert degrees(influence.out_degree(network)) == {a: sum(1 for x, _ in want if x == a) for a in {a for a, _ in want}}
