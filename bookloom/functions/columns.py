"""Reusable column expressions, and the fence that keeps costly ones from being copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def fence(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add ``columns`` so that each one is evaluated exactly once per row.

    Catalyst merges neighbouring projections and pushes filters below them, which copies an
    expensive expression into every place that reads it. A one-element ``explode`` stops both,
    costs no shuffle, and leaves the row count as it is.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.explode(F.array(packed)).alias("_fenced")).select(
        *keep, *[F.col(f"_fenced.{name}").alias(name) for name in columns]
    )


def is_filled(column: Column) -> Column:
    """Neither NULL nor blank."""
    return column.isNotNull() & (F.trim(column) != "")


def header_field(text: Column, pattern: str) -> Column:
    """The first match of a header pattern, spaces trimmed; "" when there is none."""
    return F.trim(F.regexp_extract(text, pattern, 1))


def accepted_language(language: Column) -> Column:
    return F.when(language.isin(*fixed.LANGUAGES), language)


def release_year(release_date: Column) -> Column:
    """The first four digits in a release date, whatever they stand for, or NULL."""
    return F.nullif(F.regexp_extract(release_date, fixed.YEAR, 1), F.lit("")).cast("int")


def body_text(text: Column, markers: tuple[str, str]) -> Column:
    """Lower-cased text without what stands before the start and after the end marker."""
    start, end = markers
    return F.regexp_replace(F.regexp_replace(F.lower(text), start, ""), end, "")


def body_letters(text: Column, markers: tuple[str, str]) -> Column:
    """The a-z runs of the body, with a space between them."""
    return F.regexp_replace(body_text(text, markers), "[^a-z]+", " ")


def body_tokens(text: Column, markers: tuple[str, str]) -> Column:
    """Array of a-z runs of the body; a body without letters gives one empty token."""
    return F.split(F.trim(body_letters(text, markers)), " ")


def is_stop_word(term: Column) -> Column:
    return term.isin(*fixed.STOP_WORDS)
