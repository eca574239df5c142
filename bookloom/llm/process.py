"""What a Python worker holds: from one task to the next, and at a time."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of rows that go to a Python worker together


def once_per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, or what it gave the task before, if that asked for the same ``key``.

    Functions of this package are pickled with their globals, so a module variable would start
    anew in every task; a module made here stays. Only for things that any task can make again.
    """
    kept = sys.modules.setdefault("_bookloom_kept", types.ModuleType("_bookloom_kept"))
    values = kept.__dict__.setdefault("values", {})
    if key not in values:
        values.clear()  # one thing at a time: workers outlive the query that they first ran for
        values[key] = make()
    return values[key]


def forget() -> None:
    """Let go of what ``once_per_process`` keeps.

    For tasks that keep nothing themselves: the worker may hold the tokens or hashes of another query.
    """
    if kept := sys.modules.get("_bookloom_kept"):
        vars(kept).get("values", {}).clear()


def slices(column, rows: int = 256):
    """The values of an Arrow column as Python lists of at most ``rows``, one after the other.

    A batch of texts stays in Arrow's memory; only a slice of it is Python strings at a time.
    """
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def limit_batches(spark: SparkSession) -> bool:
    """Let the session send rows to Python in batches of about ``BATCH_BYTES``; False if it has a limit of its own.

    By default a batch is up to 10,000 texts, mostly all that a task has. The JVM holds each batch twice, in
    buffers that double as they grow, and the worker once more.
    """
    if unset := spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return unset


@contextmanager
def limited_batches(spark: SparkSession) -> Iterator[None]:
    """``limit_batches`` for the jobs that run inside."""
    changed = limit_batches(spark)
    try:
        yield
    finally:
        if changed:
            spark.conf.unset(_BATCH)
