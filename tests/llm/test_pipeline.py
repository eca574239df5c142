"""The stages after one another, each held against its own input."""

import random
import re

import pytest

import corpus_pipeline
from bookloom.llm import mixing, quality, toxicity

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, class_id string"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(WORDS, k=rng.randrange(40, 120))
        bad, toxic = i % 10 == 3, i % 10 == 6
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for at in rng.sample(range(len(words)), 4):
                words[at] = rng.choice(["knave", "scoundrel"])
        rows.append((i, " ".join(words) + ".", "en", f"s{i % 4}", 0, 0.5, "x"))
        labels.append((i, int(not bad), int(toxic)))
    for i in range(0, 500, 25):  # copies, exact and with one word changed
        text = rows[i][1]
        rows.append((1000 + i, text, "en", "s1", 0, 0.5, "x"))
        rows.append((2000 + i, text.rsplit(" ", 1)[0] + " end", "en", "s1", 0, 0.5, "x"))
    rows += [(5000, None, None, None, None, None, None), (None, "no id here", "en", "s1", 0, 0.5, "x"), (5001, "", "en", "s1", 0, 0.5, "x")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def step(name, docs):
        found = stages[name](spark, docs, folder)
        assert found.columns == docs.columns
        before, after = ([tuple(r) for r in df.collect()] for df in (docs, found))
        assert set(after) <= set(before) and len(after) == len(set(after))
        return spark.createDataFrame(after, KIND), before, after

    kept, before, after = step("toxicity", docs)
    toxic = [r for r in before if r[1] and re.search("knave|scoundrel", r[1])]
    assert set(before) - set(after) == set(toxic)
    kept, before, after = step("quality", kept)
    bad = {r for r in before if r[1] and "!!" in r[1]}
    assert not bad & set(after) and len(set(before) - set(after) - bad) <= 3
    kept, before, after = step("near_dedup", kept)
    sets = {r[0]: shingles(r[1]) for r in before if r[0] is not None and r[1]}
    first = {a: min(b for b, t in sets.items() if len(s & t) >= 0.8 * len(s | t)) for a, s in sets.items()}
    assert {r[0] for r in after} == set(first.values()) | {r[0] for r in before if r[0] is None or not r[1]}
    mixed, before, after = step("mixing", kept)
    assert {r[0] for r in after if r[0] is not None} == {
        int(i) for i in mixing.mix(kept).where("selected and doc_id is not null").toPandas().doc_id}
    packed = stages["packing"](spark, mixed, folder).collect()
    assert sorted(r.doc_id or -1 for r in packed) == sorted(r[0] or -1 for r in after)


def test_run_is_the_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert found and {"doc_id", "sequence_id", "offset", "length"} <= set(found[0].asDict())


def test_a_pipeline_of_nothing(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_models_are_from_the_operators():
    assert corpus_pipeline.toxicity is toxicity and corpus_pipeline.quality is quality
