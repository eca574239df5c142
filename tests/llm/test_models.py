"""Quality, toxicity and mixing: held-out accuracy, plain estimates, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookloom.llm import mixing, process, quality, queries, toxicity

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, score double"
FOLDER = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5) for i, t in rows], KIND)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, label int")


ODD = [(9001, None), (9002, ""), (9003, "\n \t"), (None, "a text of no id"), (9004, "word " * 100_000), (9004, "word"),
       (9005, "日本 語 " * 30), (9006, "$$$")]


def good_or_bad(rng, good):
    words = rng.choices("sea king ship whale storm island captain".split(), k=rng.randrange(20, 90))
    if not good:
        words = [w.upper() + "!!" if rng.random() < 0.6 else w for w in words]
    return " ".join(words) + "."


def test_quality_on_held_out_texts(spark):
    rng = random.Random(1)
    truth = {i: int(rng.random() < 0.8) for i in range(400)}
    docs = table(spark, [(i, good_or_bad(rng, y)) for i, y in truth.items()] + ODD)
    known = [(i, y) for i, y in truth.items() if i < 250] + [(None, 1), (3, None), (77777, 0)]
    model = quality.fit(docs, labels(spark, known))
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == 400 + len(ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    wrong = [i for i, y in truth.items() if i >= 250 and (scores[i] >= 0.3) != (y == 1)]
    assert len(wrong) <= 5
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in truth if scores[i] > 0.31}


def test_the_quality_threshold_is_a_quantile_of_all_scores(spark):
    rng = random.Random(11)
    docs = table(spark, [(i, good_or_bad(rng, i % 4 > 0)) for i in range(200)]
                 + [(1000 + i, good_or_bad(rng, i % 2)) for i in range(400)])
    model = quality.fit(docs, labels(spark, [(i, int(i % 4 > 0)) for i in range(200)]), bad_share=0.4)
    raw = sorted(r.raw for r in quality.score_documents(docs, model).collect())
    assert model.cut == pytest.approx((raw[239] + raw[240]) / 2)


def test_the_threshold_lies_in_the_widest_gap_within_the_error(spark):
    rng = random.Random(12)
    values = [rng.gauss(-5, 1) for _ in range(95)] + [rng.gauss(5, 1) for _ in range(905)] + [5.0] * 300
    scores = spark.createDataFrame([(x,) for x in values], "raw double").repartition(3)
    ordered = sorted(values)
    assert quality.threshold(scores, 0.1, 0.05) == pytest.approx((ordered[94] + ordered[95]) / 2)
    assert quality.threshold(scores, 0.3) == pytest.approx((ordered[389] + ordered[390]) / 2)
    assert quality.threshold(spark.createDataFrame([(2.0,)] * 5, "raw double"), 0.5, 0.1) == 2.0


def test_quality_without_two_kinds_keeps_everything(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    for known in ([], [(1, 1)], [(1, 0)]):
        model = quality.fit(docs, labels(spark, known))
        assert quality.keep_good(docs, model).count() == 2
    empty = table(spark, [])
    assert quality.score_documents(empty, model).collect() == []


def test_preferences_order_the_scores(spark):
    rng = random.Random(2)
    docs = table(spark, [(i, good_or_bad(rng, i % 2)) for i in range(200)])
    model = quality.fit(docs, labels(spark, [(i, i % 2) for i in range(200)]))
    raw = {r.doc_id: r.raw for r in quality.score_documents(docs, model).collect()}
    pairs = [(a, b) for a in range(1, 200, 2) for b in range(0, 200, 2)]
    assert np.mean([raw[a] > raw[b] for a, b in pairs]) > 0.98


def test_features_are_finite():
    for text in (None, "", " ", "\n\n", "!", "|||", "a" * 10_000, "é ß 1 _ \x00"):
        assert np.isfinite(quality.features(text)).all()
        assert len(quality.features(text)) == len(quality.features("x"))


def spoken(rng, toxic, language):
    words = rng.choices([f"{language}{i}" for i in "abcdefghij"] + ["and", "or"], k=rng.randrange(30, 90))
    words = [w * 2 for w in words]
    if toxic:
        for at in rng.sample(range(len(words)), rng.randrange(2, 5)):
            words[at] = rng.choice(["Scoundrel", "knave!", "villain"]) if language == "x" else "bozo" + rng.choice("abcdefgh") * 3
    return " ".join(words)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    truth = {i: int(rng.random() < 0.15) for i in range(900)}
    rows = [(i, spoken(rng, y, "xy"[i % 2])) for i, y in truth.items()]
    copies = [(5000 + i, rows[next(i for i, y in truth.items() if y)][1]) for i in range(40)]
    docs = table(spark, rows + copies + ODD)
    known = [(i, y) for i, y in truth.items() if i < 600] + [(5000 + i, 1) for i in range(40)]
    model = toxicity.fit(docs, labels(spark, [*known, (None, 1), (2, None)]))
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == len(rows) + 40 + len(ODD)
    scores = {r.doc_id: r.score for r in found}
    assert all(0 <= s <= 1 for s in scores.values())
    held = [i for i in truth if i >= 600]
    assert sum((scores[i] >= 0.3) != (truth[i] == 1) for i in held) <= 3
    assert not any(scores[i] >= 0.3 for i, _ in ODD)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == {i for i, s in scores.items() if s < 0.3 and i is not None}


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "a knave"), (2, None)])
    for known in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.fit(docs, labels(spark, known))
        assert all(r.score < 0.3 for r in toxicity.score_documents(docs, model).collect())
    assert toxicity.score_documents(table(spark, []), model).collect() == []


def test_other_words_of_copied_toxic_texts_are_not_mined(spark):
    rng = random.Random(7)
    rows = [(i, spoken(rng, i % 8 == 0, "x")) for i in range(400)]
    rare = " ".join(f"rare{c}{d}" for c in "abcdefg" for d in "hijklmn")
    rows += [(1000 + i, f"{rare} scoundrel knave villain copy{chr(97 + i % 26)}") for i in range(40)]
    known = [(i, int(i % 8 == 0)) for i in range(400)] + [(1000 + i, 1) for i in range(40)]
    clean = [(2000 + i, f"{rare} copy{chr(97 + i)}") for i in range(20)]
    model = toxicity.fit(table(spark, rows + clean), labels(spark, known))
    assert not any(entry.startswith("rare") for entry in model.lexicon.places)
    scores = toxicity.score_documents(table(spark, clean), model).collect()
    assert all(r.score < 0.3 for r in scores)


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.1
    fires = lambda yes, no: np.where(truth, rng.random(len(truth)) < yes, rng.random(len(truth)) < no)
    a, b, c, d = fires(0.8, 0.02), fires(0.6, 0.01), fires(0.7, 0.05), fires(0.5, 0.01)
    copied = np.where(rng.random(len(truth)) < 0.95, d, fires(0.5, 0.01))
    votes = np.column_stack([a, b, c, d, copied]).astype(float)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_votes(patterns, counts.astype(float), 0.1)
    assert model.prior == pytest.approx(0.1, abs=0.03)
    assert model.fires[1] == pytest.approx([0.8, 0.6, 0.7, 0.5, 0.5], abs=0.12)
    assert model.fires[0] == pytest.approx([0.02, 0.01, 0.05, 0.01, 0.01], abs=0.02)
    assert model.correlations[3, 4] > 0.7 and abs(model.correlations[0, 1]) < 0.3
    assert model.voices[3] < 0.7 < model.voices[0]


def test_one_word_alone_marks_a_toxic_text():
    """Two words that nearly always go together, each with beginnings, are two voices."""
    patterns = np.array([[0] * 7, [1] * 7, [1, 1, 1, 0, 0, 0, 0]], float)
    model = toxicity.fit_votes(patterns, np.array([450.0, 47.0, 3.0]), 0.1)
    assert model.posterior(patterns) == pytest.approx([0, 1, 1], abs=0.02)


def test_scoring_lets_go_of_what_another_query_keeps(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda function: lambda column: function)
    toxic = toxicity.Model(toxicity.Lexicon({}, np.array([], int)), None, np.zeros(0), -4.0)
    good = quality.Model(np.zeros(len(quality.features(""))), 0.0, 1.0)
    for score in (toxic.score({"text": None}), good.raw({"text": None})):
        process.forget()
        made = []
        process.once_per_process("tokens", lambda: made.append(1))
        assert len(*score(iter([pa.array(["a b"])]))) == 1
        process.once_per_process("tokens", lambda: made.append(1))
        assert len(made) == 2


def test_queries_on_the_tables(spark):
    for name, column in (("op4_bradley_terry_quality", "quality"), ("op9_weak_toxicity", "toxic")):
        found = queries.queries()[name](spark, FOLDER)
        known = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(column).alias("y"))
        rows = found.join(known, "doc_id").where("held_out").collect()
        assert found.columns == ["doc_id", "held_out", "score", "predicted"]
        assert np.mean([r.predicted == r.y for r in rows]) > 0.9
        crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
        divisor, rest = (5, 0) if column == "quality" else (4, 2)
        assert found.where((crc % divisor == rest) != F.col("held_out")).count() == 0


def mixed(rng, count):
    rows = []
    for i in range(count):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        text = " ".join(rng.choices([f"{'ab'[i % 2]}{j}" for j in range(40)], k=rng.randrange(1, 60)))
        rows.append((i, text, rng.choice(["en", "fr", None]), source if i % 50 else None, 0, 1, 0.5))
    return rows


def test_raked_margins_and_sample(spark):
    rng = random.Random(5)
    rows = mixed(rng, 3000) + [(9000, None, "en", "hot", 0, 1, 0.5), (9001, "", "en", "new", 0, 1, 0.5),
                               (None, "a1 a2", "en", "hot", 0, 1, 0.5)]
    docs = spark.createDataFrame(rows, KIND)
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows)
    assert found.groupby("doc_id").size().max() == 1
    total = found.tokens.sum()
    cells = found.fillna({"source": "-", "lang": "-"}).groupby(["source", "lang", "topic"])
    cells = cells.agg(tokens=("tokens", "sum"), weight=("weight", "first"), p=("probability", "max")).reset_index()
    cells = cells[cells.tokens > 0]
    assert cells.weight.sum() == pytest.approx(1, abs=1e-6)
    for margin in ("source", "lang", "topic"):
        sums = cells.groupby(margin)[["tokens", "weight"]].sum()
        want = sums.tokens**mixing.TEMPER / (sums.tokens**mixing.TEMPER).sum()
        assert sums.weight.to_numpy() == pytest.approx(want.to_numpy(), rel=2e-3)
    assert (cells.tokens * cells.p).sum() == pytest.approx(0.5 * total, rel=1e-6)
    assert found.probability.between(0, 1).all()
    assert (found[found.tokens == 0].probability == 0).all()
    taken = found[found.selected]
    assert taken.tokens.sum() == pytest.approx(0.5 * total, rel=0.06)
    sample = mixing.sample(docs)
    assert sample.columns == docs.columns
    assert sorted(r.doc_id for r in sample.collect() if r.doc_id is not None) == sorted(taken.doc_id.dropna().astype(int))


def test_topics_are_fitted_on_all_documents(spark):
    rng = random.Random(9)
    kinds = [min(7, int(rng.expovariate(0.4))) for _ in range(5000)]
    texts = [" ".join(rng.choices([f"k{k}w{j}" for j in range(12)], k=30)) for k in kinds] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5) for i, t in enumerate(texts)], KIND)
    centres = mixing.fit_topics(docs).centres
    points = np.array([mixing.word_profile(t)[1] for t in texts])
    near = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
    for i in range(len(centres)):
        assert centres[i] == pytest.approx(points[near == i].mean(0), abs=1e-3)
    again = mixing.fit_topics(docs.repartition(7)).centres
    assert (again == centres).all()


def test_a_rare_subject_gets_a_topic(spark):
    words = [f"{a}{b}" for a in "abcdefg" for b in "hijklmn"]
    texts = [" ".join(words[k * 7 : k * 7 + 7]) for k in range(7)] * 900 + ["z1 z2 z3 z4 z5 z6 z7"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5) for i, t in enumerate(texts)], KIND)
    found = mixing.mix(docs).toPandas()
    topic = found.set_index("doc_id").topic
    assert (topic == topic[len(texts) - 1]).sum() == 1


def test_given_targets(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame(mixed(rng, 1500), KIND).where("source is not null and lang is not null")
    target = spark.createDataFrame([("=en", 0.8), ("=fr", 0.2)], "_lang string, share double")
    found = mixing.mix(docs, {"lang": target}, fraction=0.2).toPandas()
    expected = (found.tokens * found.probability).groupby(found.lang).sum()
    assert expected["en"] / expected.sum() == pytest.approx(0.8, abs=0.02)


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], KIND)
    assert mixing.mix(empty).collect() == []
    assert mixing.sample(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 0, 1, 0.5)], KIND)
    assert [r.selected for r in mixing.mix(blank).collect()] == [False]


def plain_fit(tokens, targets, rounds=2000):
    """Iterative proportional fitting of a dense array, one margin after the other."""
    weights = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums = weights.sum(tuple(i for i in range(weights.ndim) if i != axis), keepdims=True)
            by = np.divide(target.reshape(sums.shape), sums, out=np.zeros_like(sums), where=sums > 0)
            weights = weights * by
    return weights


def cells_of(spark, tokens):
    rows = [(f"s{i}", f"l{j}", k, int(n)) for (i, j, k), n in np.ndenumerate(tokens) if n]
    return spark.createDataFrame(rows, "source string, lang string, topic int, tokens bigint").repartition(3)


def shares(spark, name, values):
    kind = "int" if name == "topic" else "string"
    label = (lambda i: i) if name == "topic" else (lambda i: f"{name[0]}{i}")
    return spark.createDataFrame([(label(i), float(v)) for i, v in enumerate(values)], f"{name} {kind}, share double")


def test_factors_give_what_plain_fitting_gives(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 50, (9, 4, 3)) * (rng.random((9, 4, 3)) < 0.7)
    tokens[0] *= 1000  # a hot source
    targets = [rng.random(n) + 0.1 for n in tokens.shape]
    targets = [t / t.sum() for t in targets]
    tables = {n: shares(spark, n, t) for n, t in zip(mixing.MARGINS, targets)}
    raked = mixing.rake(cells_of(spark, tokens), tables, tolerance=1e-7)
    assert raked.deviation <= 1e-7 and not raked.moved
    want = plain_fit(tokens.astype(float), targets)
    found = np.zeros(tokens.shape)
    for r in raked.cells.collect():
        found[int(r.source[1:]), int(r.lang[1:]), r.topic] = r.weight
    assert found == pytest.approx(want, abs=1e-6)


def test_margins_that_no_weights_have(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STALLED", 4)
    # Topics are parts of languages, so the shares of topics fix those of languages.
    tokens = np.zeros((3, 2, 4))
    tokens[:, 0, :2], tokens[:, 1, 2:] = 10, 30
    tables = {"source": shares(spark, "source", [0.2, 0.3, 0.5]), "lang": shares(spark, "lang", [0.5, 0.5]),
              "topic": shares(spark, "topic", [0.1, 0.1, 0.4, 0.4])}
    raked = mixing.rake(cells_of(spark, tokens), tables)
    assert raked.moved and raked.deviation <= mixing.TOLERANCE
    sums = raked.cells.toPandas().groupby("source").weight.sum()
    assert sums.to_numpy() == pytest.approx([0.2, 0.3, 0.5], rel=2e-3)
    kept = mixing.rake(cells_of(spark, tokens), tables, ["lang"])
    assert kept.cells.toPandas().groupby("lang").weight.sum().to_numpy() == pytest.approx([0.5, 0.5], rel=2e-3)
    with pytest.raises(ValueError, match="no weights"):
        mixing.rake(cells_of(spark, tokens), tables, ["lang", "topic"])


def test_names_that_clash_with_the_mixing_columns(spark):
    rows = [(i, f"a{i % 7} b c", "en", f"s{i % 3}", 1, "x", 0.5, 2) for i in range(200)]
    names = "doc_id bigint, text string, lang string, source string, tokens int, _about string, probability double, topic int"
    docs = spark.createDataFrame(rows, names)
    kept = mixing.sample(docs)
    assert kept.dtypes == docs.dtypes
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= set(rows) and 0 < len(found) < len(rows)
