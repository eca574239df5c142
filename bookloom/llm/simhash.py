"""Near copies by SimHash: fingerprints of shingles, compared exactly in tiles.

A fingerprint's bit is set if more than half of the shingles' hashes have it. Distinct
fingerprints are cut into tiles by the number of their bits; a pair of tiles is compared only if
these numbers come within the radius, and inside a pair fingerprints are set against those runs
whose quarters have near enough numbers of bits, since every bit that differs changes the number of
one quarter by one. What remains is compared whole, by exclusive or and bit count.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import numbered
from ..sources.staging import stage
from .components import components
from .process import slices

WORDS = 3  # of a shingle
RADIUS = 2  # bits that linked fingerprints differ by at most
SEED = 42
TILE = 1 << 15  # fingerprints of a tile
_HASHES = 1 << 15  # counted at a time
_PAIRS = 16  # pairs of tiles in a partition, about
_BLOCK = 1 << 20  # comparisons made at a time


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles, repeats included; 0 for a text without words or null.

    A-Z count as a-z, and words are what ASCII white space separates. A text of fewer words than a
    shingle has is one shingle as a whole.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = list(accumulate((len(part) + 1 for part in parts), initial=0))
    ends = starts[words:] if len(parts) >= words else starts[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), _HASHES):
        some = zip(starts[at : at + _HASHES], ends[at : at + _HASHES])
        hashes = [digest(joined[start : end - 1], SEED) for start, end in some]
        counts += _bit_counts(np.array(hashes, np.uint64))
    bits = np.packbits(2 * counts > len(ends))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a bigint) of every row; other columns are ignored."""

    def of(batches):
        for batch in batches:
            found = [fingerprint(text) for some in slices(batch.column(1)) for text in some]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fingerprint"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id bigint, fingerprint bigint")


def _quarters(prints: np.ndarray) -> np.ndarray:
    """The numbers of bits in the four quarters of each fingerprint, one row each."""
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by the bit numbers of their quarters, those numbers, and the runs' starts."""
    quarters = _quarters(prints)
    order = np.lexsort(quarters.T)
    prints, quarters = prints[order], quarters[order]
    new = np.ones(len(prints), bool)
    new[1:] = (quarters[1:] != quarters[:-1]).any(1)
    starts = np.flatnonzero(new)
    return prints, quarters[starts], np.append(starts, len(prints))


class _Forest:
    """Which of numbered things hang together."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        self.up[max(x, y)] = min(x, y)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what all pairs of ``left`` and ``right`` within ``radius`` bits connect.

    Each links a fingerprint with the first of those that it hangs together with here, so that they
    are stars and not chains. Both sides hold distinct unsigned fingerprints; ``right`` is None to
    compare ``left`` with itself.
    """
    a, keys_a, starts_a = _runs(left)
    b, keys_b, starts_b = (a, keys_a, starts_a) if right is None else _runs(right)
    shift = 0 if right is None else len(a)
    forest = _Forest(len(a) if right is None else len(a) + len(b))
    for run, key in enumerate(keys_a):
        apart = np.abs(keys_b - key).sum(1)
        near = np.flatnonzero(apart <= radius)
        if right is None:
            near = near[near >= run]
        if not len(near):
            continue
        places = np.concatenate([np.arange(starts_b[j], starts_b[j + 1]) for j in near])
        own = a[starts_a[run] : starts_a[run + 1]]
        rows = max(1, _BLOCK // len(places))
        for at in range(0, len(own), rows):
            bits = np.bitwise_count(own[at : at + rows, None] ^ b[places][None, :])
            i, j = np.nonzero(bits <= radius)
            i, j = i + starts_a[run] + at, places[j]
            if right is None:
                i, j = i[i < j], j[i < j]
            for x, y in zip(i.tolist(), (j + shift).tolist()):
                forest.join(x, y)
    value = np.concatenate([a, b]) if right is not None else a
    return [(int(value[top]), int(value[x])) for x in range(len(value)) if (top := forest.top(x)) != x]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct ``fingerprint`` values that connect whatever is near.

    Ordered by the number of their bits, the fingerprints are cut into tiles of ``tile``. Pairs of tiles
    are listed by number only, those beyond the radius left out; then each gets its two tiles,
    which are one row each. A task holds a pair of tiles and reports fewer links than fingerprints.
    """
    bits = F.bit_count("fingerprint").alias("bits")
    ordered = numbered(prints.select(bits, "fingerprint"), ["bits", "fingerprint"], "place")
    tiles = stage(
        ordered.groupBy(F.floor(F.col("place") / tile).alias("tile")).agg(
            F.min("bits").alias("fewest"), F.max("bits").alias("most"), F.collect_list("fingerprint").alias("prints")
        ),
        "tiles",
    )
    # A tile's partners are those numbered from it on whose fewest bits it reaches.
    ends = tiles.select("tile", "fewest", "most")
    reach = ends.select("tile", F.explode(F.sequence("fewest", F.col("most") + radius)).alias("bits"))
    span = ends.select(F.col("tile").alias("other"), F.explode(F.sequence("fewest", "most")).alias("bits"))
    pairs = reach.join(span, "bits").where(F.col("tile") <= F.col("other")).select("tile", "other").distinct()
    pairs = stage(pairs, "pairs")
    number = pairs.count()
    held = tiles.select("tile", "prints")
    work = (
        pairs.join(held, "tile")
        .join(held.select(F.col("tile").alias("other"), F.col("prints").alias("others")), "other")
        .repartition(max(1, min(number, 64), math.ceil(number / _PAIRS)), "tile", "other")
        .select("prints", F.when(F.col("tile") != F.col("other"), F.col("others")).alias("others"))
    )

    def compare(batches):
        for batch in batches:
            for i in range(len(batch)):
                left = batch.column(0)[i].values.to_numpy().view(np.uint64)
                right = batch.column(1)[i]
                right = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                found = np.array(tile_links(left, right, radius), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return work.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` is 16 hex digits. Fingerprints link at ``radius`` or fewer differing bits, and a
    component is what links connect, equal fingerprints included; it is named by the smallest id
    in it. Null and empty texts, and those of white space only, have the fingerprint zero and are
    linked like any other. A row without an id links as well, but names no component: if no row
    of one has an id, the name is null. Repeated rows and ids keep a row each. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    found = stage(fingerprints(documents, id_col, text_col), "fingerprints")
    # One row for each fingerprint from here on, however many copies it has.
    distinct = stage(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    joined = components(links(distinct, radius))
    placed = distinct.join(joined, distinct["fingerprint"] == joined["id"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    placed = stage(placed, "placed")
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(placed.join(names, "component").select("fingerprint", "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")
