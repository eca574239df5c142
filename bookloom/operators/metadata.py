"""Header fields of whole books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import (
    accepted_language,
    fence,
    header_field,
    is_filled,
    release_year,
)

_PATTERNS = {
    "title": fixed.TITLE,
    "release_date": fixed.RELEASE_DATE,
    "language": fixed.LANGUAGE,
    "encoding": fixed.ENCODING,
}


def extract_metadata(
    books: DataFrame, fields: Sequence[str] = ("title", "release_date", "language", "encoding")
) -> DataFrame:
    """``file_name`` and the named header fields; ``release_year`` follows ``release_date``.

    Absent fields are "", but a language outside the accepted list and an unknown year are NULL.
    Every field is one search through the text, so name only those that are needed.
    """
    found = {name: header_field(F.col("text"), _PATTERNS[name]) for name in fields}
    metadata = fence(books, ["file_name"], **found)
    if "language" in found:
        metadata = metadata.withColumn("language", accepted_language(F.col("language")))
    if "release_date" in found:
        metadata = metadata.withColumn("release_year", release_year(F.col("release_date")))
    return metadata


def extract_authors(books: DataFrame) -> DataFrame:
    """``file_name, author, release_date, release_year``; NULL author when no line names one.

    ``fixed.AUTHOR_BY_ALONE`` is not searched for: whatever it matches, ``fixed.AUTHOR_BY``
    matches before it.
    """
    text = F.col("text")
    labelled = fence(
        books,
        ["file_name", "text"],
        label=header_field(text, fixed.SEARCHED_LABEL),
        release_date=header_field(text, fixed.RELEASE_DATE),
    )
    # The second search runs only for books without a labelled author.
    byline = F.when(F.col("label") != "", F.col("label")).otherwise(
        header_field(text, fixed.SEARCHED_BY)
    )
    return fence(labelled, ["file_name", "release_date"], author=byline).select(
        "file_name",
        F.nullif("author", F.lit("")).alias("author"),
        "release_date",
        release_year(F.col("release_date")).alias("release_year"),
    )


def valid_author_books(authors: DataFrame) -> DataFrame:
    """Books with a usable author and a known year: ``file_name, author, release_year``."""
    name = F.lower(F.trim("author"))
    return authors.where(
        is_filled(F.col("author"))
        & F.col("release_year").isNotNull()
        & ~name.isin(*fixed.NOT_AUTHORS)
    ).select("file_name", "author", "release_year")
