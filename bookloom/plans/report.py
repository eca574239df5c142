"""A stored table of header fields, and the statistics of a collection from it.

Each function in ``operators.stats`` searches the texts again when it is given extracted metadata. Here
the headers are searched once, and what they say is written by release year, so that files carry
the range of their years: a filter on it is pushed into the scan, and texts are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metadata, stats
from ..sources.staging import new_path, stage

FIELDS = ("title", "release_date", "language", "encoding")


def metadata_table(books: DataFrame, path: str | None = None) -> DataFrame:
    """``file_name, title, release_date, language, encoding, release_year`` of all books, written to ``path``.

    Rows are dealt out by ranges of years and sorted within; a year of very many books is several
    files. Books without a year come first. An empty table is written as such. An existing path is
    an error; without one the table goes to the shared folder.
    """
    found = metadata.extract_metadata(books, FIELDS).select("file_name", *FIELDS, "release_year")
    found = stage(found, "fields")  # dealing out by range reads its input twice, which should not be the texts
    placed = found.repartitionByRange("release_year", "file_name").sortWithinPartitions("release_year", "file_name")
    path = path or new_path(books.sparkSession, "metadata")
    placed.write.parquet(path)
    return books.sparkSession.read.schema(placed.schema).parquet(path)


def books_of_years(table: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of a ``metadata_table`` from ``first`` to ``last``, inclusive; only files with such years are read."""
    return table.where(F.col("release_year").between(first, last))


def _measure(df: DataFrame, measure: str, value: Column, name: Column | None = None) -> DataFrame:
    name = F.lit("") if name is None else name.cast("string")
    return df.select(F.lit(measure).alias("measure"), name.alias("name"), value.cast("double").alias("value"))


def report(table: DataFrame) -> DataFrame:
    """``measure, name, value``: every statistic of the collection, from a ``metadata_table``.

    Measures are ``total_books``, ``books_per_year`` and ``language_counts`` (by name), ``missing_years``,
    ``average_title_length`` (null without titles) and the four counts of missing fields.
    """
    missing = stats.missing_metadata(table)
    measures = [
        _measure(stats.total_books(table), "total_books", F.col("total_books")),
        _measure(stats.books_per_year(table), "books_per_year", F.col("number_of_books"), F.col("release_year")),
        _measure(stats.language_counts(table), "language_counts", F.col("book_count"), F.col("language")),
        _measure(stats.missing_year_count(table), "missing_years", F.col("missing_years")),
        _measure(stats.average_title_length(table), "average_title_length", F.col("average_title_length")),
        *[_measure(missing, name, F.col(name)) for name in missing.columns],
    ]
    return reduce(DataFrame.unionByName, measures)
