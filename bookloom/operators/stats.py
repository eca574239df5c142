"""Summaries of a metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_filled


def books_per_year(metadata: DataFrame) -> DataFrame:
    return (
        metadata.where(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(F.count("*").alias("number_of_books"))
        .orderBy("release_year")
    )


def missing_year_count(metadata: DataFrame) -> DataFrame:
    return metadata.agg(F.count_if(F.col("release_year").isNull()).alias("missing_years"))


def language_counts(metadata: DataFrame) -> DataFrame:
    """Books per language, most frequent first, equal counts by name."""
    return (
        metadata.where(is_filled(F.col("language")))
        .groupBy("language")
        .agg(F.count("*").alias("book_count"))
        .orderBy(F.desc("book_count"), "language")
    )


def top_language(metadata: DataFrame) -> DataFrame:
    return language_counts(metadata).limit(1)


def average_title_length(metadata: DataFrame) -> DataFrame:
    """Mean number of characters of the titles that are present."""
    return metadata.where(is_filled(F.col("title"))).agg(
        F.avg(F.length("title")).alias("average_title_length")
    )


def missing_metadata(metadata: DataFrame) -> DataFrame:
    """How many books lack each field, in one pass."""
    return metadata.agg(
        *[
            F.count_if(~F.coalesce(is_filled(F.col(name)), F.lit(False))).alias(f"missing_{name}s")
            for name in ("title", "release_date", "language", "encoding")
        ]
    )


def total_books(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("total_books"))
