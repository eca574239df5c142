"""Text-file sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def read_books(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file: ``file_name, text``.

    The name is the last path part if it ends in ``.txt``, else "". It is URI-encoded, as Spark
    reports it: ``a b.txt`` reads ``a%20b.txt``.
    For many files name their folder: it is listed once, where a pattern makes each file that it
    matches a path to be listed by itself.
    """
    files = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), fixed.FILE_NAME, 1).alias("file_name"),
        F.col("value").alias("text"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per line of one or many files: ``value``. Lines end in LF, CR or CRLF."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths))


def read_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``word, count`` from files of ``word<TAB>count`` lines, as ``write_counts`` leaves them."""
    line = F.split("value", "\t")
    return read_lines(spark, paths).select(
        F.get(line, 0).alias("word"), F.get(line, 1).cast("bigint").alias("count")
    )
