"""Which lists of spans of years reach each other, by sets of lists for each year, inside a task."""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions travel with the task, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REACHED = "group_a bigint, group_b bigint"


class Spans(NamedTuple):
    """Lists of spans end to end: those of ``ids[i]`` are at ``starts[i] : starts[i + 1]``."""

    ids: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Spans:
        """From columns ``profile, first, last``."""
        lists = [table[name].combine_chunks() for name in ("first", "last")]
        starts = lists[0].offsets.to_numpy().astype(np.int64)
        flat = [column.flatten().to_numpy().astype(np.int64) for column in lists]
        return cls(table["profile"].to_numpy(), starts - starts[0], *flat)


def _covering(spans: Spans, longest: int) -> np.ndarray:
    """``[k, y]``: which lists have a span over any of the ``2**k`` years from the ``y``-th on, a bit each.

    ``y`` counts from the first year of all; ``2**k`` goes up to ``longest``.
    """
    low, high = spans.first.min(), spans.last.max()
    owners = np.repeat(np.arange(len(spans.ids)), np.diff(spans.starts))
    edges = np.zeros((high - low + 2, len(spans.ids)), np.int8)
    edges[spans.first - low, owners] += 1
    edges[spans.last - low + 1, owners] -= 1  # spans of a list do not touch
    one = np.packbits(np.cumsum(edges[:-1], axis=0, dtype=np.int8).astype(bool), axis=1)
    levels = np.zeros((int(longest).bit_length(), *one.shape), np.uint8)
    levels[0] = one
    for k in range(1, len(levels)):
        half = 1 << (k - 1)
        levels[k] = levels[k - 1]
        levels[k, :-half] |= levels[k - 1, half:]
    return levels


def reached(left: Spans, right: Spans, years: int) -> pa.Table:
    """``group_a, group_b``: each of ``left`` with all of ``right`` that it reaches, each pair once.

    What a span reaches is a run of years, and that is two runs of a power of two years, so a list
    takes two look-ups for each of its spans, whatever it reaches and however often.
    """
    a, b = [], []
    if len(left.first) and len(right.first):
        low, high = right.first.min(), right.last.max()
        begin, end = np.maximum(left.first - years, low) - low, np.minimum(left.last + years, high) - low
        length = np.maximum(end - begin + 1, 0)
        levels = _covering(right, max(1, length.max()))
        power = np.frexp(np.maximum(length, 1))[1] - 1
        for i, own_id in enumerate(left.ids):
            own = np.arange(left.starts[i], left.starts[i + 1])
            own = own[length[own] > 0]
            k = power[own]
            met = levels[k, begin[own]] | levels[k, end[own] + 1 - (1 << k)]
            bits = np.unpackbits(np.bitwise_or.reduce(met, axis=0), count=len(right.ids))
            b.append(right.ids[np.flatnonzero(bits)])
            a.append(np.full(len(b[-1]), own_id))
    both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.table({"group_a": pa.array(both[0], pa.int64()), "group_b": pa.array(both[1], pa.int64())})
