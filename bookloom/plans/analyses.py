"""The analyses a user runs on a table of books (``file_name, text``).

Each scans the texts once. What several branches need afterwards is staged: a small table of
author profiles, or one row of counted terms per book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import influence, metadata, similarity, term_index
from ..operators import terms as term_ops
from ..sources.staging import stage


def author_network(
    books: DataFrame, years: int = fixed.INFLUENCE_YEARS
) -> influence.Network:
    """The staged network of authors, the input of the functions in ``operators.influence``."""
    valid = metadata.valid_author_books(metadata.extract_authors(books))
    return influence.author_network(valid, years)


def counted_terms(books: DataFrame) -> DataFrame:
    """Staged ``book_terms``, the input of the functions in ``operators.terms``."""
    return stage(term_ops.book_terms(books), "terms")


def weighted_terms(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged counted terms of the books, and the ``idf`` of their vocabulary."""
    terms = counted_terms(books)
    return terms, term_ops.idf(terms, term_ops.vocabulary(terms))


def cosines(books: DataFrame, target: str) -> DataFrame:
    """``file_name, cosine`` of every other book to ``target``."""
    terms, idf = weighted_terms(books)
    return similarity.cosine_to_target(terms, stage(idf, "idf"), target)


def similar_books(books: DataFrame, target: str, rows: int = fixed.TOP_SIMILAR) -> DataFrame:
    """``rank, file_name, cosine`` of the books most similar to ``target``."""
    return similarity.top_similar(cosines(books, target), rows)


def book_index(books: DataFrame) -> term_index.TermIndex:
    """A stored index of the books, for ``term_index.search`` with any number of targets."""
    terms, idf = weighted_terms(books)
    return term_index.build_index(terms, stage(idf, "idf"))


def book_pairs(books: DataFrame, min_cosine: float) -> DataFrame:
    """``book_a, book_b, cosine`` of all pairs of books that reach ``min_cosine``."""
    keyed = stage(similarity.keyed_terms(term_ops.book_terms(books)), "terms")
    idf = term_ops.idf(keyed, term_ops.vocabulary(keyed))
    units = stage(similarity.unit_vectors(keyed, idf), "units")
    return similarity.similarity_pairs(keyed, units, min_cosine)


def rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))
