"""The Merkle manifest against one built in plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bookloom.llm import manifest, queries

KIND = "text string, doc_id bigint, lang string, source string, n_chars bigint, leaf string, key string, place int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    shown = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields]
    return digest(*shown)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root of a list of hashes, and the steps of each (before, after)."""
    where, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, at in enumerate(where):
            run = runs[at // 8]
            steps[i].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        where, nodes = [at // 8 for at in where], [digest(*run) for run in runs]
    return nodes[0], steps


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        changed = leaf_of(row, row["text"] if row["text"] is None else lowered(row["text"])) if hit else None
        groups[row["lang"]].append((row["doc_id"], leaf_of(row, row["text"]), changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in order:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
        trees[name] = climb([leaf for _, leaf, _ in groups[name]])
    root, above = climb([trees[name][0] for name in order])
    found = []
    for name, upper in zip(order, above):
        subroot, steps = trees[name]
        for (doc_id, leaf, changed), own in zip(groups[name], steps):
            now, path = changed or leaf, own + upper
            for before, after in path:
                now = digest(before, now, after)
            found.append((doc_id, leaf, subroot, root, digest(*[a + b for a, b in path]), now, now == root))
    return found


def table(spark, rows):
    return spark.createDataFrame(
        [(r["text"], r["doc_id"], r["lang"], r["source"], r["n_chars"], "x", "y", 1) for r in rows], KIND
    ).repartition(3)


def query(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in queries.queries()["op11_merkle_manifest"](spark, str(tmp_path)).select(names).collect()]


def row(doc_id, text="Text", lang="en", source="s", n_chars=4):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


def test_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    ids = rng.sample(range(-3000, 3000), 600) + [rng.getrandbits(62) - 2**61 for _ in range(80)] + [2**63 - 1, -(2**63), 0x7FFF, 63, 64, 127]
    rows = [row(i, rng.choice(["Ab É", "ab", "", None, "Z" * 300]), rng.choice(["en", "de", "é", "", None]), rng.choice(["s", None]), rng.choice([None, 3])) for i in ids]
    rows += [row(7, lang="one")]
    rows += [row(i, t) for i in (5, 64, None) for t in ("A", "b", "A", "C", "A", None)] + [row(9, "Same", None)] * 20  # repeated ids and rows
    rows += [row(None, "x", None)] * 3 + [row(2, "x" * 200_000, "long")]
    assert Counter(query(spark, rows, tmp_path)) == Counter(expected(rows))


def test_few_and_none(spark, tmp_path):
    assert query(spark, [], tmp_path / "none") == []
    one = [row(None, None, None, None, None)]
    assert query(spark, one, tmp_path / "one") == expected(one)
    # Groups of one leaf, a run, a run and one, eight runs and one.
    rows = [row(i, lang=f"g{n}") for n in (1, 8, 9, 65) for i in range(n)] + [row(3, lang=g) for g in "abcdefghi"]
    found = query(spark, rows, tmp_path / "some")
    assert Counter(found) == Counter(expected(rows))


def test_a_hot_row_is_listed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(manifest, "_COPIES", 7)
    rows = [row(1, "same")] * 50 + [row(1, "Other"), row(0), row(2)]
    built = manifest.build(manifest.document_leaves(table(spark, rows)))
    found = built.proofs.orderBy("place").collect()
    assert [r.place for r in found] == list(range(53)) and found[0].id == 0 and found[-1].id == 2


    assert built.proofs.where(manifest.folded(F.col("leaf"), F.col("path")) != built.root).count() == 0


def test_the_tree_is_built_without_texts(spark):
    built = manifest.build(manifest.document_leaves(table(spark, [row(i) for i in range(10)])))
    columns = built.proofs._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in columns and "octet_length" not in columns
