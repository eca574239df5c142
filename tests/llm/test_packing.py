"""Packing: ids as the tokenizer gives them, and places that fit."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bookloom.llm import packing, process
from bookloom.llm.queries import tokenizer_path

PATH = tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
ENCODE = packing.word_encoder(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(
    st.sampled_from("aAbß éÉÄäñ\n\t 's'LL0129.,;:!?-_()<|>"), st.characters(blacklist_categories=["Cs"])), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", [
    "a<|endoftext|>b", "x <|startoftext|> y", "we'll DON'T it's 12345", "ΑΣ ς İstanbul", "é ́x",
    "a\x1cb\x85c d\r\ne", "Straße ungß", "", " ", "\n\n", "日本語 текст", "!!!... $$$ ×÷",
])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == ids_of(text)


def test_words_are_remembered_once(monkeypatch):
    monkeypatch.setattr(packing, "_KEPT", 4000)
    encode = packing.word_encoder(PATH)
    encode("a")
    texts = [" ".join(f"{w}, {w.title()}. {w};" for w in words_of(n)) for n in range(20)]
    tracemalloc.start()
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 75 * 4000


def words_of(n):
    letters = "bcdfghjklm"
    return ["".join(letters[int(d)] for d in str(1000 * n + i)) for i in range(1000)]


def bins_of(runs):
    bins = defaultdict(list)
    for length, count, first, each, offset in runs:
        for i in range(count):
            bins[first + i // each].append((offset + i % each * length, length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 30)), max_size=25), st.sampled_from([60, 61, 100]))
def test_runs_hold_every_piece_once(pairs, capacity):
    counts = dict(pairs)
    bins = bins_of(packing.plan_runs(counts, capacity))
    held = defaultdict(int)
    for number in range(len(bins)):
        end = 0
        for offset, length in sorted(bins[number]):
            assert offset == end
            end += length
            held[length] += 1
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in bins[number]) <= 2
    assert held == counts
    total = sum(length * n for length, n in counts.items())
    halves = sum(n for length, n in counts.items() if 2 * length > capacity)
    assert len(bins) <= max(halves, -(-total // capacity)) * 1.5 + 2


def test_large_pieces_meet_their_best_partners():
    bins = bins_of(packing.plan_runs({70: 2, 30: 1, 29: 1, 40: 1, 36: 1, 55: 1}, 100))
    assert sorted(sorted(length for _, length in b) for b in bins.values()) == [
        [29, 70], [30, 70], [36], [40, 55]]


KIND = "doc_id bigint, text string, lang string, length string, sequence_id int, piece int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "", 0, 0) for i, t in rows], KIND)


def check(rows, found, capacity):
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.start].append(r)
    wanted = defaultdict(list)
    for doc, text in rows:
        ids = ids_of(text) + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            wanted[doc, at].append((piece, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in wanted.items()} == {
        k: sorted((r.piece, r.length, r.ids_crc32) for r in v) for k, v in pieces.items()
    }
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_documents_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "_CHUNK", 50)  # a hot length is ranked in several chunks
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["sea", "king", "whale's", "Äther"], k=rng.randrange(0, 90)))) for i in range(400)]
    rows += [(1000 + i, "same text") for i in range(300)] + [(7, "same text"), (7, "same text")]
    rows += [(2000, None), (2001, ""), (None, "no id"), (2002, "long " * 1000)]
    found = packing.pack_documents(table(spark, rows), PATH, capacity=64).collect()
    count = check(rows, found, 64)
    tokens = sum(r.length for r in found)
    assert count <= 1.02 * tokens / 64 + 1


def test_ids_can_be_kept(spark):
    rows = [(1, "a king at sea"), (2, "sea " * 9)]
    found = packing.pack_documents(table(spark, rows), PATH, capacity=4, keep_ids=True).collect()
    joined = {}
    for r in sorted(found, key=lambda r: r.piece):
        joined.setdefault(r.doc_id, []).extend(r.ids)
    assert joined == {doc: ids_of(text) + [1] for doc, text in rows}


def test_empty_table(spark):
    assert packing.pack_documents(table(spark, []), PATH).collect() == []


def test_batches_are_limited_while_texts_are_cut(spark, monkeypatch):
    key, seen, stage = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.stage
    monkeypatch.setattr(packing, "stage", lambda *a: seen.append(spark.conf.get(key)) or stage(*a))
    before = spark.conf.get(key)
    packing.pack_documents(table(spark, [(1, "a king at sea")]), PATH)
    assert seen == [str(process.BATCH_BYTES)] and spark.conf.get(key) == before


def test_batches_stay_near_the_limit(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 9000, 1, 1).selectExpr("concat(id, repeat('a king at sea ', 200)) AS text")
    with process.limited_batches(spark):
        found = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) > 6 * process.BATCH_BYTES and max(found) < 1.2 * process.BATCH_BYTES
