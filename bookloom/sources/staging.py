"""Tables written once to a shared folder and read by several later steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str | None] = ContextVar("staging_scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else one in ``spark.sql.warehouse.dir``.

    The same rule holds in every mode: both settings name storage that all executors reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[str]:
    """A scope whose staged tables are deleted at its end; yields their folder.

    Results that read staged tables must be written or collected inside the scope.
    """
    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    before = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the scope's folder, else the shared one, that nothing has been written to."""
    return f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there.

    Used where several branches of a query need the same costly result: the texts are then
    scanned once, the plan starts anew at a columnar table, and losing an executor loses nothing.
    Outside a ``staging_scope`` nothing deletes the table.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
