"""A stored inverted index of books, for many targets one after another.

``cosine_to_target`` reads the terms of all books for each target. Here the unit weights are laid out
by term once, in partitions that hold a few terms each, with the largest weight of every list. A
target then reads the partitions of its own terms only, most promising lists first, and stops
opening lists once what is left cannot lift a book that it has not met into the report.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.staging import new_path, stage
from .terms import normalize, tfidf

LIST_ROWS = 1_000_000  # of a partition of the lists, about
NAME_ROWS = 100_000  # of a partition of the books, about
NAME_FILES = 8  # of a partition of the books, as each book is a long row
FIRST_TERMS = 16  # lists read at first; then twice as many, and so on
_SLACK = 1e-6  # cosines are reported to six digits: what could tie there is kept


class TermIndex(NamedTuple):
    """Tables as ``build_index`` leaves them."""

    lists: DataFrame  # term, book, file_name, unit, by ``part``, the largest unit of a term first
    terms: DataFrame  # term, idf, part, largest
    books: DataFrame  # book, file_name, terms (term, tf), by ``part`` of the name
    parts: int
    name_parts: int


class Found(NamedTuple):
    """What ``search`` returns."""

    cosines: DataFrame  # file_name, cosine
    opened: int  # lists that were read in full
    lists: int  # lists of the target's terms


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _laid_out(df: DataFrame, parts: int, files: int, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` written with a folder for each ``part`` of ``key``, of ``files`` files at most."""
    path = new_path(df.sparkSession, name)
    salt = F.pmod(F.xxhash64("book"), F.lit(files)).alias("_salt")
    placed = df.withColumn("part", _part(F.col(key), parts)).select("*", salt)
    placed = placed.repartition("part", "_salt").sortWithinPartitions("part", *order).drop("_salt")
    placed.write.partitionBy("part").parquet(path)
    kind = placed.select(*[c for c in placed.columns if c != "part"], "part").schema
    return df.sparkSession.read.schema(kind).parquet(path)


def build_index(terms: DataFrame, idf: DataFrame) -> TermIndex:
    """Index the (staged) ``book_terms`` by the weights that ``idf`` gives; the texts are not read."""
    # A list has a row for each book of its term, so nothing has to be staged to be counted. The weights
    # are many rows, and go one way only: from the books to the lists.
    weights = normalize(tfidf(terms, idf)).where(F.col("weight") > 0)
    rows = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    books = terms.count()
    parts = max(1, min(math.ceil(rows / LIST_ROWS * 8), idf.count()))
    name_parts = max(1, math.ceil(books / NAME_ROWS))
    lists = _laid_out(
        weights.select("term", "book", "file_name", F.col("weight").alias("unit")),
        parts, max(1, math.ceil(rows / LIST_ROWS / parts)), "term", [F.col("term"), F.desc("unit"), F.col("book")], "lists",
    )
    largest = lists.groupBy("term", "part").agg(F.max("unit").alias("largest"))
    # A book is one row here; its weights are worked out when it is a target.
    named = terms.select("book", "file_name", "terms")
    return TermIndex(
        lists,
        stage(largest.join(idf.select("term", "idf"), "term").select("term", "idf", "part", "largest"), "largest"),
        _laid_out(named, name_parts, NAME_FILES, "file_name", [F.col("file_name"), F.col("book")], "named"),
        parts,
        name_parts,
    )


def _target(index: TermIndex, target: str) -> tuple[bool, dict[str, Row]]:
    """Whether there is a book of that name, and ``term, unit, part, largest`` of the first such."""
    named = index.books.where(_literal_part(index.books, target, index.name_parts)).where(F.col("file_name") == target)
    book = named.agg(F.min("book")).first()[0]
    if book is None:
        return False, {}
    own = named.where(F.col("book") == book).select(F.explode("terms").alias("entry")).select("entry.*")
    # At most as many rows as the vocabulary has terms.
    found = own.join(index.terms, "term").select("term", (F.col("tf") * F.col("idf")).alias("weight"), "part", "largest").collect()
    norm = math.sqrt(math.fsum(r["weight"] ** 2 for r in found))
    return True, {r["term"]: Row(unit=r["weight"] / norm, part=r["part"], largest=r["largest"]) for r in found}


def _literal_part(table: DataFrame, key: str, parts: int) -> Column:
    """A condition on ``part`` that the scan can prune folders by."""
    number = table.sparkSession.range(1).select(_part(F.lit(key), parts)).first()[0]
    return F.col("part") == number


def opened_lists(index: TermIndex, parts: list[int], names: list[str]) -> DataFrame:
    """The lists of the terms ``names``, which are in ``parts``; other folders are not read."""
    return index.lists.where(F.col("part").isin(parts)).where(F.col("term").isin(names))


def search(index: TermIndex, target: str, rows: int = fixed.TOP_SIMILAR) -> Found:
    """Cosines of the books that are among the ``rows`` most similar to ``target``, and maybe more.

    Ties at six digits are included, so that any order of equal cosines can be reported. Lists are
    opened in the order of what they can add at most: the target's weight times the list's
    largest. Once all that is left adds up to less than the least of the ``rows`` best sums so far, a
    book not met yet is out; those that may still get there are completed from the other lists,
    read for them alone. Books without a common term come last, with 0, by name. A target is
    compared with no book of its name; if there is none, no row is returned.
    """
    spark = index.lists.sparkSession
    present, known = _target(index, target)
    nothing = spark.createDataFrame([], "file_name string, cosine double")
    if not present:
        return Found(nothing, 0, 0)
    most = {term: r["unit"] * r["largest"] for term, r in known.items()}
    order = sorted(known, key=lambda term: (-most[term], term))
    left = [most[term] for term in order]
    rest = [sum(left[i:]) for i in range(len(left) + 1)]

    def sums(names: list[str], only: DataFrame | None = None) -> DataFrame:
        lists = opened_lists(index, sorted({known[t]["part"] for t in names}), names)
        lists = lists.where(F.col("file_name") != target)
        lists = lists if only is None else lists.join(only.select("book"), "book", "left_semi")
        weights = spark.createDataFrame([(t, known[t]["unit"]) for t in names], "term string, weight double")
        # At most as many rows as the vocabulary has terms.
        lists = lists.join(F.broadcast(weights), "term")
        return lists.groupBy("book", "file_name").agg(F.sum(F.col("unit") * F.col("weight")).alias("dot"))

    partial, opened, step = None, 0, FIRST_TERMS
    while opened < len(order):
        some = sums(order[opened : opened + step])
        both = some if partial is None else partial.unionByName(some)
        partial = stage(both.groupBy("book", "file_name").agg(F.sum("dot").alias("dot")), "partial")
        opened = min(len(order), opened + step)
        step = opened  # the number of passes is logarithmic
        best = [r["dot"] for r in partial.orderBy(F.desc("dot")).limit(rows).select("dot").collect()]
        if len(best) == rows and rest[opened] < best[-1] - _SLACK:
            break
    if partial is None:
        met = spark.createDataFrame([], "book bigint, file_name string, dot double")
    elif opened == len(order):
        met = partial
    else:
        hopeful = stage(partial.where(F.col("dot") + rest[opened] >= best[-1] - _SLACK), "hopeful")
        added = sums(order[opened:], hopeful)
        met = hopeful.unionByName(added).groupBy("book", "file_name").agg(F.sum("dot").alias("dot"))
    met = stage(met, "met")
    cosines = met.select("file_name", F.col("dot").alias("cosine"))
    if met.count() < rows:  # then all books with a common term are among them
        others = index.books.where(F.col("file_name") != target).join(met.select("book"), "book", "left_anti")
        zeros = others.orderBy("file_name").limit(rows).select("file_name", F.lit(0.0).alias("cosine"))
        cosines = cosines.unionByName(zeros)
    return Found(cosines, opened, len(order))
