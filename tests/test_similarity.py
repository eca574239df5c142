import random
from collections import Counter

import numpy as np
import pytest

from bookloom.functions import vectors
from bookloom.functions.vectors import Vectors
from bookloom.operators import pairs, similarity, terms
from bookloom.plans import analyses
from bookloom import sources
from bookloom.sources import stage

from test_terms import WHALES


def ranked(books, texts, target, rows=5):
    return [tuple(r) for r in analyses.similar_books(books(texts), target, rows).collect()]


def test_top_similar(books):
    assert ranked(books, WHALES, "1") == [
        (1, "2", 0.718831), (2, "4", 0.254382), (3, "3", 0.06471), (4, "5", 0.0),
    ]


def test_unknown_target(books):
    assert ranked(books, WHALES, "6") == []


def test_target_without_weights_still_gets_five(books):
    texts = WHALES | {"6": "1", "7": "alone"}
    assert ranked(books, texts, "5") == [(i, str(n), 0.0) for i, n in enumerate((1, 2, 3, 4, 6), 1)]


def test_fewer_overlaps_than_rows(books):
    texts = {"a": "sea", "b": "sea", "c": "x y", "d": "y z", "e": "q", "f": "r", "g": "s"}
    top = ranked(books, texts, "a")
    assert [name for _, name, _ in top] == ["b", "c", "d", "e", "f"]
    assert [cosine for _, _, cosine in top] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_ranked_before_rounding(spark):
    df = spark.createDataFrame([("a", 0.1000001), ("b", 0.1000002)], "file_name string, cosine double")
    assert [tuple(r) for r in similarity.top_similar(df).collect()] == [(1, "b", 0.1), (2, "a", 0.1)]


def random_texts(seed, count, kinds, length):
    rng = random.Random(seed)
    words = ["w" + "".join(chr(97 + (i // 26**k) % 26) for k in range(2)) for i in range(kinds)]
    odds = [1 / (i + 1) for i in range(kinds)]
    return {
        f"b{i:03}": " ".join(rng.choices(words, odds, k=rng.randint(1, length)))
        for i in range(count)
    }


def all_cosines(books, texts):
    counted = terms.book_terms(books(texts))
    unit = terms.normalize(terms.tfidf(counted, terms.idf(counted, terms.vocabulary(counted))))
    names, words, entries = sorted(texts), {}, []
    for r in unit.collect():
        entries.append((names.index(r.file_name), words.setdefault(r.term, len(words)), r.weight))
    matrix = np.zeros((len(names), max(1, len(words))))
    for row, column, weight in entries:
        matrix[row, column] = weight
    return names, matrix @ matrix.T


def wanted_pairs(names, cosines, least):
    return {
        (a, b): round(float(cosines[i, j]), 6)
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if a < b and round(float(cosines[i, j]), 6) >= least
    }


def found_pairs(df):
    rows = df.collect()
    found = {(r.book_a, r.book_b): r.cosine for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("least", [0.05, 0.3, 0.7, 1.0])
def test_all_pairs_above_a_cosine(books, least):
    texts = random_texts(7, 60, 80, 25)
    texts |= {"z1": "", "z2": "12", "z3": "unique", "z4": texts["b001"]}
    want = wanted_pairs(*all_cosines(books, texts), least)
    found = found_pairs(analyses.book_pairs(books(texts), least))
    assert found == pytest.approx(want, abs=2e-6)


def test_many_copies_and_hot_terms_in_small_blocks(books, monkeypatch, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(similarity, "blocks", lambda df: pairs.blocks(df, bits=2))
    monkeypatch.setattr(similarity, "_GROUP_BYTES", 2000)  # many parts and chunks
    texts = random_texts(9, 30, 40, 12)
    texts |= {f"c{i}": "whale sea ship" for i in range(25)}  # copies
    texts |= {f"d{i}": "whale " * (i + 1) + "sea" for i in range(10)}  # one hot term
    want = wanted_pairs(*all_cosines(books, texts), 0.5)
    assert sum(a[0] == b[0] == "c" for a, b in want) == 25 * 24 // 2
    found = found_pairs(analyses.book_pairs(books(texts), 0.5))
    assert found == pytest.approx(want, abs=2e-6)


def unit_table(books, texts):
    keyed = stage(similarity.keyed_terms(terms.book_terms(books(texts))), "terms")
    return stage(similarity.unit_vectors(keyed, terms.idf(keyed, terms.vocabulary(keyed))), "units")


def in_arrow(units, least):
    dealt = similarity._dealt(units, least, 1)
    return Vectors.of(dealt.toArrow())


def test_leading_terms_save_work(books):
    held = in_arrow(unit_table(books, random_texts(4, 80, 200, 60)), 0.8)
    index = vectors._Index.of(held, int(held.terms.max()) + 1)
    met = sum(len(vectors._met(index, len(held.ids), held, row, 0.8)) - 1 for row in range(len(held.ids)))
    assert met < 80 * 79 // 4
    assert held.leads.sum() < 0.8 * len(held.terms)


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_an_index_against_all_products(books, least):
    held = in_arrow(unit_table(books, random_texts(13, 70, 90, 30)), least)
    dense = np.zeros((len(held.ids), int(held.terms.max()) + 1))
    for row in range(len(held.ids)):
        own = slice(held.starts[row], held.starts[row + 1])
        dense[row, held.terms[own]] = held.units[own]
    product = dense @ dense.T
    want = {(a, b): product[i, j] for i, a in enumerate(held.ids.tolist()) for j, b in enumerate(held.ids.tolist()) if a < b and product[i, j] >= least}
    found = vectors.similar_pairs(held, None, least).to_pylist()
    assert {(r["group_a"], r["group_b"]): r["cosine"] for r in found} == pytest.approx(want)
    assert len(found) == len(want)


def test_min_cosine_must_be_positive(spark):
    with pytest.raises(ValueError):
        similarity.similarity_pairs(spark.range(1), spark.range(1), 0)


def test_no_books(books):
    nothing = books({"1": "x"}).limit(0)
    assert analyses.book_pairs(nothing, 0.5).count() == 0
    assert analyses.similar_books(nothing, "1").count() == 0


def test_books_of_the_same_name_from_files(spark, tmp_path):
    texts = {"a/1.txt": "whale sea ship", "b/1.txt": "king queen sea", "a/2.txt": "whale ship king", "b/x.md": "sea king", "a/y.md": "queen sea"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    books = sources.read_books(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    found = analyses.similar_books(books, "2.txt")
    assert sorted(r.file_name for r in found.collect()) == ["", "", "1.txt", "1.txt"]
    out = str(tmp_path / "out")
    found.write.parquet(out)
    assert spark.read.parquet(out).count() == 4


def test_groups_of_pairs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_GROUP_BYTES", 60_000)
    monkeypatch.setattr(similarity, "_PART_ROWS", 500)
    entry = "struct<term:int,unit:double,before:double,after:double>"
    units = spark.range(4000).selectExpr(
        "id", f"cast(transform(sequence(1, if(id % 500 = 0, 300, 5)), x -> struct(int(x), 0.1D, 0.5D, 0.4D)) as array<{entry}>) as entries"
    )
    parts = similarity._parts(units)
    assert parts == 8  # 4,000 rows, 447,000 bytes
    groups = {}
    for r in similarity._dealt(units, 0.3, parts).selectExpr("i", "j", "part", "id", "size(term) as n").collect():
        groups.setdefault((r.i, r.j), []).append((r.part, r.id, r.n))
    assert len(groups) == parts * (parts + 1) // 2
    assert max(sum(20 * n for *_, n in rows) for rows in groups.values()) <= 2.5 * 60_000
    met = {(min(a, b), max(a, b)) for rows in groups.values() for p, a, _ in rows[:40] for q, b, _ in rows[:40] if a != b}
    assert met
    of = {i: p for rows in groups.values() for p, i, _ in rows}
    assert len(of) == 4000
    for (i, j), rows in groups.items():  # a pair of parts holds all of both
        assert sorted(r[1] for r in rows) == sorted(x for x, p in of.items() if p in (i, j))


def test_no_rows_of_pairs_are_generated(books):
    units = unit_table(books, WHALES)
    plan = similarity._similar(units, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "FlatMapGroupsInArrow" in plan  # the parts that a vector meets


def test_a_meeting_is_dropped_only_below_the_threshold(books):
    texts = random_texts(12, 120, 60, 30)
    for least in (0.2, 0.6, 0.9):
        want = wanted_pairs(*all_cosines(books, texts), least)
        assert found_pairs(analyses.book_pairs(books(texts), least)) == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("bits", [1, 11])
def test_tiles_give_the_same_pairs_and_shuffle_none(books, spark, monkeypatch, bits):
    rng = random.Random(17)
    texts = {f"b{i}": " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(rng.randrange(1, 9))) for i in range(60)}
    texts |= {f"c{i}": "copy of one text" for i in range(7)} | {"n": None, "e": ""}
    table = books(texts).unionByName(spark.createDataFrame([("c1", "copy of one text"), ("b1", "aa bb")], "file_name string, text string"))
    monkeypatch.setattr(similarity, "blocks", lambda df: pairs.blocks(df, bits=bits))
    found = {}
    for most in (10**6, 0):
        monkeypatch.setattr(similarity, "_DEALT_PARTS", most)
        monkeypatch.setattr(similarity, "_PART_ROWS", 9)
        monkeypatch.setattr(similarity, "_BATCH_NAMES", 5)
        df = analyses.book_pairs(table, 0.4)
        found[most] = Counter((r.book_a, r.book_b, r.cosine) for r in df.collect())
    assert found[0] == found[10**6] and found[0][("c0", "c1", 1.0)] == 2 and len(found[0]) > 60
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def made_vectors(seed, count, kinds, length, first_id=0):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(kinds, 0, -1)
    rows = [np.sort(rng.choice(kinds, rng.integers(1, length), replace=False, p=odds / odds.sum())) for _ in range(count)]
    units = [x / np.linalg.norm(x) for x in (rng.random(len(row)) for row in rows)]
    after = [np.sqrt(np.maximum(0, 1 - np.cumsum(x * x))) for x in units]
    leads = [int(np.count_nonzero(np.concatenate([[1.0], a[:-1]]) >= 0.4)) for a in after]
    starts = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    return Vectors(first_id + np.arange(count), starts, *map(np.concatenate, (rows, units, after)), np.array(leads))


def products(left, right, size):
    sides = [vectors._split(side, 0, size)[0] for side in (left, right)]
    return sides[0] @ sides[1].T


@pytest.mark.parametrize("frequent", [0, 1, 7, 40])
def test_blocks_find_what_all_products_find(monkeypatch, frequent):
    monkeypatch.setattr(vectors, "_BLOCK", 16)
    monkeypatch.setattr(vectors, "_SLICE", 50)
    left, right = made_vectors(1, 90, 40, 12), made_vectors(2, 70, 40, 12, 90)
    for gather in (1, 12, 10**6):  # in a matrix, either, one by one
        monkeypatch.setattr(vectors, "_GATHER", gather)
        for other in (right, None):
            product = products(left, left if other is None else other, 40)
            want = {(i, j): product[i, j] for i, j in zip(*np.nonzero(product >= 0.4)) if other is not None or i < j}
            found = [x for some in vectors._by_blocks(left, other, 0.4, 40, 40 - frequent) for x in zip(*some)]
            assert {(a, b): c for a, b, c in found} == pytest.approx(want) and len(found) == len(want) > 50
            found = [(a, b) for some in vectors._by_leads(left, other, 0.4, 40) for a, b, _ in zip(*some)]
            assert sorted(found) == sorted(want)


def test_frequent_terms_are_not_looked_up_for_each_pair(monkeypatch):
    held, ranges, looked_up = made_vectors(3, 400, 60, 50), vectors._ranges, []
    monkeypatch.setattr(vectors, "_ranges", lambda starts, lengths: looked_up.append(int(np.sum(lengths))) or ranges(starts, lengths))
    found = vectors.similar_pairs(held, None, 0.4)
    assert len(found) == np.count_nonzero(np.triu(products(held, held, 60) >= 0.4, 1)) > 10_000
    assert sum(looked_up) < 400 * 400  # terms of 400 * 399 / 2 pairs


def test_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(5)
    ties = [k / 10**7 for k in range(4_999_995, 5_000_100, 10)] + [0.1234565, 0.9999995, 1.0000000000000002, 0.49999949999999997]
    values = np.array([*ties, *rng.random(2000), *(rng.integers(0, 10**6, 500) + 0.5) / 10**6])
    rows = spark.createDataFrame([(float(x),) for x in values], "x double").selectExpr("x", "round(x, 6) as y").collect()
    assert vectors._rounded(np.array([r.x for r in rows]), 6).tolist() == [r.y for r in rows]


def test_a_tile_is_one_value_and_no_row_of_pairs_is_exploded(books, monkeypatch):
    monkeypatch.setattr(similarity, "_DEALT_PARTS", 0)
    monkeypatch.setattr(similarity, "_PART_ROWS", 10)
    staged = {}
    monkeypatch.setattr(similarity, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    df = analyses.book_pairs(books(random_texts(21, 60, 60, 20)), 0.3)
    assert staged["tiles"].dtypes == [("tile", "bigint"), ("packed", "binary")] and staged["tiles"].count() >= 3
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.dtypes == [("book_a", "string"), ("book_b", "string"), ("cosine", "double")] and df.count() > 20


def test_terms_of_books_are_not_shuffled_to_the_vocabulary(books, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    keyed = stage(similarity.keyed_terms(terms.book_terms(books(WHALES))), "terms")
    units = similarity.unit_vectors(keyed, terms.idf(keyed, terms.vocabulary(keyed)))
    assert "SortMergeJoin" not in units._jdf.queryExecution().executedPlan().toString()
