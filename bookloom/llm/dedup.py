"""Near-duplicate documents with ProbMinHash.

A text is a weighted set: its five-word shingles and how often each occurs. The similarity is
the probability Jaccard index ``J_P = Σ_i 1 / Σ_j max(v_j / v_i, w_j / w_i)``, which for texts
without repeated shingles is the Jaccard index. Signatures estimate it: every shingle sends
exponential arrivals of a rate that is its weight, each to the next register of an order of its
own; a register keeps its first arrival's shingle, and a shingle stops as soon as its next arrival
comes after the last register's. Bands of registers propose families of documents, and within a family the index is
verified exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import numbered
from ..sources.staging import stage
from .components import components
from .process import once_per_process

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6  # of similar pairs at the threshold itself, 0.07 % share no band
REGISTERS = 149  # a prime; the first BANDS * ROWS of them are read
FAMILY_ROWS = 256  # documents verified together; a larger family is cut into such blocks
_KEPT = 150_000  # words whose hashes a task remembers
_TEXTS = 64  # texts worked on at a time

_LETTERS = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64's constants
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A random-looking permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def word_hashes() -> Callable[[str | None], np.ndarray]:
    hashes = once_per_process("word_hashes", _Hashes)

    def of(text: str | None) -> np.ndarray:
        words = _LETTERS.findall((text or "").lower())
        return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))

    return of


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` words, repeats included; of all words, if they are fewer."""
    if not len(words):
        return words
    width = min(WORDS, len(words))
    count = len(words) - width + 1
    rolled = np.zeros(count, np.uint64)
    for i in range(width):
        rolled = _mixed(rolled * _STEP + words[i : i + count])
    return rolled


class Weighted(NamedTuple):
    """Weighted sets one after the other."""

    keys: np.ndarray
    weights: np.ndarray
    owners: np.ndarray  # the set of each key
    sets: int


def weighted_sets(many: list[np.ndarray]) -> Weighted:
    """Distinct keys of each set with their numbers of occurrences."""
    keys, weights, owners = [], [], []
    for owner, values in enumerate(many):
        own, counts = np.unique(values, return_counts=True)
        keys.append(own)
        weights.append(counts)
        owners.append(np.full(len(own), owner))
    return Weighted(
        np.concatenate(keys), np.concatenate(weights).astype(float), np.concatenate(owners), len(many)
    )


def signatures(sets: Weighted, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures: a row of ``registers`` keys for each set; empty sets give zeros.

    All keys of all sets send their n-th arrival together; those whose arrival comes after the
    last register of their set is filled are done. A key visits every register once (start and
    step come from its hash, and ``registers`` is prime), so its n-th arrival waits as the n-th
    new register of a Poisson process does. Large sets stop after a few arrivals each.
    """
    first = np.full(sets.sets * registers, np.inf)
    holder = np.zeros(sets.sets * registers, np.uint64)
    keys, rates, base = sets.keys, sets.weights, sets.owners * registers
    order = _mixed(keys ^ _STEP)
    at = (order % np.uint64(registers)).astype(np.int64)
    step = (_mixed(order) % np.uint64(registers - 1)).astype(np.int64) + 1
    time = np.zeros(len(keys))
    for turn in range(registers):
        random = _mixed(keys + np.uint64(int(_STEP) * (turn + 1) % 2**64))
        uniform = ((random >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / rates * (registers / (registers - turn))
        register = base + at
        early = np.flatnonzero(time < first[register])
        # Of several arrivals at a register the first stays: written last.
        early = early[np.argsort(-time[early], kind="stable")]
        first[register[early]] = time[early]
        holder[register[early]] = keys[early]
        last = first.reshape(sets.sets, registers).max(1)
        open_ = time < last[base // registers]
        if not open_.any():
            break
        keys, rates, base, time = keys[open_], rates[open_], base[open_], time[open_]
        step = step[open_]
        at = (at[open_] + step) % registers
    return holder.reshape(sets.sets, registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    rolled = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for i in range(ROWS):
        rolled = _mixed(rolled * _STEP + parts[:, :, i])
    return rolled.astype(np.int64)


def probability_jaccard(a: Weighted, b: Weighted) -> float:
    """The exact index of two single sets, with sorted keys."""
    common, i, j = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    v, w = a.weights[i], b.weights[j]
    ratio = v / w
    order = np.argsort(ratio, kind="stable")
    ratio, v, w = ratio[order], v[order], w[order]
    # Keys of a alone exceed any ratio, keys of b alone fall below any.
    alone_a, alone_b = a.weights.sum() - v.sum(), b.weights.sum() - w.sum()
    start = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(v[::-1])[::-1], [0.0]])[start] + alone_a
    below = np.concatenate([[0.0], np.cumsum(w)])[start] + alone_b
    return float((1.0 / (above / v + below / w)).sum())


def profiles(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, content, bands`` of documents that have an id and a word.

    ``content`` is a 128-bit hash of the words in order: equal for texts that differ in case and
    signs only.
    """

    def profile(batches):
        of = word_hashes()
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.slice(at, _TEXTS)
                words = [of(text) for text in part.column(1).to_pylist()]
                some = [i for i, own in enumerate(words) if len(own)]
                if not some:
                    continue
                sets = weighted_sets([shingles(words[i]) for i in some])
                bands = bands_of(signatures(sets))
                content = [xxhash.xxh128_digest(words[i].tobytes()) for i in some]
                offsets = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.array(content, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                    ["doc_id", "content", "bands"],
                )

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.where(F.col("doc_id").isNotNull()).mapInArrow(
        profile, "doc_id bigint, content binary, bands array<bigint>"
    )


def proposed(profiled: DataFrame) -> DataFrame:
    """``a, b, shared``: links that join each document to the first one of every band they share.

    They only say who has to be compared; as many links as documents in shared bands, however
    many share one. ``shared`` is the number of bands.
    """
    buckets = profiled.select("doc_id", F.explode("bands").alias("bucket"))
    firsts = (
        buckets.groupBy("bucket")
        .agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"))
        .where(F.col("b") != F.col("last"))
        .select("bucket", "b")
    )
    # Staged, so that a bucket of very many documents can be split in the join.
    links = buckets.join(stage(firsts, "buckets"), "bucket").select(F.col("doc_id").alias("a"), "b")
    return links.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def similar_links(
    ids: list, texts: list, of: Callable, least: float, core: np.ndarray
) -> list[tuple[int, int]]:
    """Links of at least ``least``, enough of them to connect whatever is connected by such links.

    Those marked ``core`` are known to be connected already.

    The share of a set's weight that lies on another's keys is an upper bound of the index, and
    one matrix product gives it for all pairs. Pairs that reach it are worked out, the most
    promising first, unless links found before connect them already.
    """
    each = [weighted_sets([shingles(of(text))]) for text in texts]
    keys = np.concatenate([one.keys for one in each])
    owner = np.repeat(np.arange(len(each)), [len(one.keys) for one in each])
    distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    kept = times[place] > 1
    total = np.array([one.weights.sum() for one in each])
    weight = np.concatenate([one.weights for one in each]) / total[owner]
    row, share = owner[kept], weight[kept]
    column = np.unique(place[kept], return_inverse=True)[1]
    cover = np.zeros((len(each), len(each)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column, share = row[order], column[order], share[order]
    width = 2048
    for begin in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        there = np.zeros((len(each), width), np.float32)
        shares = np.zeros((len(each), width), np.float32)
        there[row[lo:hi], column[lo:hi] - begin] = 1.0
        shares[row[lo:hi], column[lo:hi] - begin] = share[lo:hi]
        cover += shares @ there.T
    bound = np.minimum(cover, cover.T)
    a, b = np.nonzero(np.triu(bound >= least - 1e-3, 1))
    best = np.argsort(-bound[a, b], kind="stable")
    root = list(range(len(each)))
    for place in np.flatnonzero(core).tolist():
        root[place] = int(core.argmax())

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(a[best].tolist(), b[best].tolist()):
        x, y = top(i), top(j)
        if x != y and probability_jaccard(each[i], each[j]) >= least:
            root[x] = y
            links.append((ids[i], ids[j]))
    return links


def _star_links(near: DataFrame, candidates: DataFrame, large: DataFrame, least: float) -> DataFrame:
    """``a, b``: links of ``least`` or more between documents of large families and their pivots.

    A document's pivot is the one of ``candidates`` that it shares most bands with, so each is
    compared once. The documents of a pivot are dealt to blocks, which get the pivot's text.
    """
    own = candidates.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")
    stars = own.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("pivot"))
    stars = stage(stars, "stars")
    blocks = stars.groupBy("pivot").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("int").alias("blocks"))
    blocks = stage(blocks, "pivots")
    block = F.pmod(F.xxhash64("a", F.lit(31)), F.col("blocks")).cast("int")
    cells = stars.join(blocks, "pivot").select(F.col("a").alias("doc_id"), "pivot", block.alias("block"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    cells = cells.unionByName(blocks.select(F.col("pivot").alias("doc_id"), "pivot", each))

    def verify(table: pa.Table) -> pa.Table:
        of = word_hashes()
        ids, pivot = table["doc_id"].to_pylist(), table["pivot"][0].as_py()
        measured = lambda text: weighted_sets([shingles(of(text))])
        centre = measured(table["text"][ids.index(pivot)].as_py())
        found = [
            i for i, text in zip(ids, table["text"])
            if i != pivot and probability_jaccard(measured(text.as_py()), centre) >= least
        ]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([pivot] * len(found), pa.int64())})

    texts = near.select("doc_id", "text").join(cells.hint("merge"), "doc_id")
    return texts.groupBy("pivot", "block").applyInArrow(verify, "a bigint, b bigint")


def _with_cores(families: DataFrame, stars: DataFrame) -> DataFrame:
    """``doc_id, family, core``: whether a document is in its family's largest part by ``stars``."""
    parts = components(stars).withColumnRenamed("id", "doc_id")
    placed = stage(families.join(parts, "doc_id", "left"), "parts")
    largest = (
        placed.where(F.col("component").isNotNull())
        .groupBy("family", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("family")
        .agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    )
    core = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    named = placed.join(stage(largest, "largest"), "family", "left")
    return stage(named.select("doc_id", "family", core.alias("core")), "cores")


def _block_links(near: DataFrame, families: DataFrame, least: float) -> DataFrame:
    """``a, b``: links of ``least`` or more inside families (``doc_id, family, core``).

    A family's core is connected already and is not compared with itself. The core and the rest
    are each cut into blocks of about ``FAMILY_ROWS`` by a hash, and a block of the rest meets
    every block of its family in one group; families of one block share groups. No group holds
    more than about twice ``FAMILY_ROWS`` texts, and none reports more links than documents.
    """
    many = lambda which: F.ceil(F.count_if(which) / FAMILY_ROWS).cast("int")
    sizes = families.groupBy("family").agg(many(~F.col("core")).alias("rest"), many("core").alias("cores"))
    sizes = stage(sizes.where(F.col("rest") > 0), "sizes")
    groups = max(1, -(-families.count() // FAMILY_ROWS))
    hashed = F.xxhash64("doc_id", F.lit(29))
    own = F.when(F.col("core"), F.col("rest") + F.pmod(hashed, F.greatest("cores", F.lit(1))))
    meets = F.when(F.col("core"), F.col("rest")).otherwise(F.col("rest") + F.col("cores"))
    alone = F.col("rest") + F.col("cores") == 1
    cells = (
        families.join(sizes, "family")
        .withColumn("own", own.otherwise(F.pmod(hashed, F.col("rest"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
        .select(
            "doc_id",
            "core",
            F.when(alone, F.pmod(F.xxhash64("family"), F.lit(groups)))
            .otherwise(F.xxhash64("family")).alias("group"),
            F.when(alone, 0).otherwise(F.least("own", "other") + 1).alias("i"),
            F.greatest("own", "other").alias("j"),
        )
    )

    def verify(table: pa.Table) -> pa.Table:
        of = word_hashes()
        family, core = table["family"].to_numpy(), table["core"].to_numpy()
        ids, texts = table["doc_id"].to_numpy(), table["text"]
        order = np.lexsort((ids, family))
        links = []
        for rows in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            own = texts.take(pa.array(rows)).to_pylist()
            links += similar_links(ids[rows].tolist(), own, of, least, core[rows])
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (
        near.join(cells.hint("merge"), "doc_id").groupBy("group", "i", "j").applyInArrow(verify, "a bigint, b bigint")
    )


def verified(
    documents: DataFrame,
    families: DataFrame,
    candidates: DataFrame,
    least: float,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """``a, b``: links of similarity ``least`` or more inside families (``doc_id, family``).

    In a family of more than ``FAMILY_ROWS`` documents each is first compared with one pivot. What
    these links connect most of is the family's core; then only documents outside of it are
    compared with the core and with each other. So a large group of near copies takes work in
    proportion to its size, and all pairs that might connect anything more are still covered.
    """
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # The families' ids grow with the documents, so they are not broadcast, however few they are.
    near = stage(texts.join(families.hint("merge"), "doc_id"), "near")
    sizes = families.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_ROWS)
    large = stage(families.join(stage(sizes, "large"), "family", "left_semi"), "members")
    stars = stage(_star_links(near, candidates, large, least), "stars")
    return _block_links(near, _with_cores(families, stars), least).unionByName(stars)


def near_duplicates(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, class_id, copies``: the class of every id, and how many ids it has.

    Two documents are linked if their words are equal or their index is ``similarity`` or more,
    and classes are what links connect; a class is named by its smallest id. Texts without a
    word (null and empty ones too) are a class of their own, each. Texts of fewer than five words
    have one shingle. An id that is repeated is one document, with all its texts. Rows without an
    id give no row; an empty table gives none; other columns are ignored.
    """
    profiled = stage(profiles(documents, id_col, text_col), "profiles")
    # Of texts with the same words one takes part; the others follow it.
    firsts = profiled.groupBy("content").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.any_value("bands").alias("bands")
    )
    firsts = stage(firsts, "firsts")
    hot = firsts.where(F.col("first") != F.col("last")).select("content", "first")
    same = profiled.select("content", "doc_id").join(hot, "content")
    same = same.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    candidates = stage(proposed(firsts.select(F.col("first").alias("doc_id"), "bands")), "proposed")
    families = components(candidates)
    families = stage(families.withColumnsRenamed({"id": "doc_id", "component": "family"}), "families")
    links = verified(documents, families, candidates, similarity, id_col, text_col)
    classes = components(links.unionByName(same))
    ids = documents.select(F.col(id_col).cast("bigint").alias("doc_id"))
    ids = ids.where(F.col("doc_id").isNotNull()).distinct()
    named = ids.join(classes, ids["doc_id"] == classes["id"], "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id")
    )
    named = stage(named, "classes")
    sizes = stage(named.groupBy("class_id").agg(F.count("*").alias("copies")), "copies")
    return named.join(sizes, "class_id").select("doc_id", "class_id", "copies")


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, key, text``: each row with its id, or a number of its own if that id has other texts.

    Of different texts that share an id the one of the smallest hash keeps it; the others get
    numbers beyond all ids (or below them, where there is no room), so that each is a document.
    Only rows of such ids are numbered, and equal texts of an id stay one document.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in documents.columns])
    rows = documents.select(
        row.alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("hash"),
    )
    texts = rows.where(F.col("id").isNotNull()).select("id", "hash")
    shared = texts.groupBy("id").agg(F.min("hash").alias("first"), F.max("hash").alias("last"))
    shared = stage(shared.where(F.col("first") != F.col("last")).select("id", "first"), "shared")
    others = texts.join(shared, "id").where(F.col("hash") != F.col("first")).select("id", "hash").distinct()
    others = numbered(others, ["id", "hash"])
    low, high = texts.agg(F.min("id"), F.max("id")).first()
    many = others.count()
    start = 0 if low is None else high + 1 if high + many < 2**63 else low - many
    own = others.select("id", "hash", (F.col("number") + F.lit(start)).alias("own"))
    found = rows.join(own, ["id", "hash"], "left")
    return found.select("row", F.coalesce("own", "id").alias("key"), "text")


def keep_representatives(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``documents``, columns as they are, without those of a smaller id's near copies.

    Rows without an id stay. Of rows that repeat an id and a text one stays; different texts of one
    id are documents by themselves. An empty table gives no rows.
    """
    rows = _keyed(documents, id_col, text_col)
    classes = near_duplicates(rows, similarity, "key", "text")
    copies = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("key"))
    kept = rows.where(F.col("key").isNotNull()).join(copies, "key", "left_anti").dropDuplicates(["key"])
    found = kept.unionByName(rows.where(F.col("key").isNull())).select("row")
    return found.select(*[F.col("row").getField(name).alias(name) for name in documents.columns])
