"""Repairs against all sequences of edits, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest

from bookloom.llm import conversations, queries

KIND = "text string, conv_id bigint, lost string, turn bigint, role string, copy int, fate int"


def cheapest(rows):
    """``cost, audit, lines`` by searching the edits in the order of cost, then letters, of whole sequences."""
    best = {}

    def search(i, roles, cost, audit, lines, inserted):
        key = (i, "s" if roles == "s" else roles[-1:], inserted)
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        old = best.get(key)
        if old is not None and old < (cost, audit):
            return
        best[key] = (cost, audit)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            ends.append((cost, audit, lines))
        if inserted < 3:
            for name in ("user", "assistant"):
                search(i, roles + name[0], cost + 2, audit + "I", lines + [name + ":"], inserted + 1)
        if i < len(rows):
            role, text, gone, cut = rows[i]
            search(i + 1, roles, cost + 3, audit + "D", lines, 0)
            if not gone:
                if role[:1]:
                    search(i + 1, roles + role[0], cost + cut, audit + "K", lines + [f"{role}:{text}"], 0)
                for name in ("user", "assistant"):
                    search(i + 1, roles + name[0], cost + 2 + cut, audit + "R", lines + [f"{name}:{text}"], 0)

    ends = []
    search(0, "", 0, "", [], 0)
    return min(ends)


def repaired(rows):
    audit, lines = [], []

    def emit(letter, line):
        audit.append(letter)
        lines.extend([] if line is None else [line])

    repair = conversations.Repair(emit)
    for role, text, gone, cut in rows:
        repair.row(role, text, gone, cut)
    cost = repair.done()
    return cost, "".join(audit), lines


@pytest.mark.parametrize("seed", range(8))
def test_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = []
        for i in range(rng.randrange(7)):
            gone = rng.random() < 0.2
            rows.append((rng.choice(["user", "assistant", "system", "tool", "", "u"]), f"t{i}", gone, not gone and rng.random() < 0.4))
        assert repaired(rows) == cheapest(rows)


def test_only_undecided_edits_are_held():
    rng = random.Random(9)
    repair = conversations.Repair(lambda letter, line: None)
    most = 0
    for i in range(20_000):
        repair.row(rng.choice(["user", "assistant", "assistant", "system"]), "t", rng.random() < 0.1, rng.random() < 0.3)
        seen, todo = set(), [repair.root]
        while todo:
            node = todo.pop()
            seen.add(id(node))
            todo += node.hanging.values()
        most = max(most, len(seen))
    assert most < 100


def plain(rows):
    """The query's rows in plain Python."""
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        text, role = show(text), show(role)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        groups[conv_id] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    found = []
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        seen, counts, taken, illegal = set(), [0, 0, 0], [], 0
        for i, (_, role, text) in enumerate(own):
            end = text.strip(" \t\n\x0b\f\r")[-1:]
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            taken.append((role, text, kind in (0, 1), kind == 2))
            illegal += i > 0 and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit, lines = cheapest(taken)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return found


def query(spark, rows, tmp_path):
    table = spark.createDataFrame([(t, c, "x", n, r, 5, 7) for c, n, r, t in rows], KIND).repartition(4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(r) for r in queries.queries()["op12_conversation_repair"](spark, str(tmp_path)).collect()]


def test_the_query(spark, tmp_path):
    rng = random.Random(10)
    texts = ["Yes.", "No", "Why?  ", "", " \t", "é ", " ", "same.", "end!\n\n", None]
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 3, -2, 40]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)))
    rows += [(None, i, "user", f"t{i}.") for i in range(6)] + [(-5, None, "user", "a." * 100_000)]
    found, wanted = query(spark, rows, tmp_path), plain(rows)
    assert len(found) == len(wanted) and set(found) == set(wanted)


def test_all_rows_lost(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"1:{i}".encode()) % 20 == 0)
    found = query(spark, [(1, lost, "user", "a")], tmp_path)
    assert found == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_texts_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a", False)], "conv_id bigint, turn bigint, role string, text string, lost boolean")
    plan = conversations.repair(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
