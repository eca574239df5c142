"""Entry points: the flagship query, all queries, and the SQL each is checked against."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookloom.functions import fixed  # noqa: E402
from bookloom.operators import influence, metadata, similarity, stats, term_index, wordcount  # noqa: E402
from bookloom.operators import terms as term_ops  # noqa: E402
from bookloom.plans import analyses, report  # noqa: E402
from bookloom.plans.analyses import rounded  # noqa: E402
from bookloom.sources import new_path, read_books, read_counts, read_lines, write_books, write_counts  # noqa: E402
from document_books import books_from_documents, duckdb_statement  # noqa: E402

TARGET = "10.txt"
FIRST_YEAR, LAST_YEAR = 1920, 1939
TARGETS = ("10.txt", "11.txt", "150.txt")
MIN_COSINE = 0.5


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _books(spark: SparkSession, folder: str) -> DataFrame:
    return books_from_documents(_documents(spark, folder))


def entry(spark: SparkSession) -> DataFrame:
    """Books per release year."""
    books = _books(spark, "/root/testdata/sf0.001")
    return stats.books_per_year(metadata.extract_metadata(books, ["release_date"]))


def _on_metadata(operator: Callable[[DataFrame], DataFrame], *fields: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(metadata.extract_metadata(_books(spark, folder), fields))

    return query


def _on_books(operator: Callable[[DataFrame], DataFrame]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(_books(spark, folder))

    return query


def _on_network(operator: Callable[[influence.Network], DataFrame]):
    return _on_books(lambda books: operator(analyses.author_network(books)))


def _on_weights(operator: Callable[[DataFrame, DataFrame], DataFrame]):
    return _on_books(lambda books: operator(*analyses.weighted_terms(books)))


def _on_lines(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return wordcount.word_count(_documents(spark, folder), mode, "text")

    return query


def _valid_books(books: DataFrame) -> DataFrame:
    return metadata.valid_author_books(metadata.extract_authors(books))


def _term_frequency(books: DataFrame) -> DataFrame:
    terms = analyses.counted_terms(books)
    return term_ops.term_frequency(terms, term_ops.vocabulary(terms))


def _tfidf(terms: DataFrame, idf: DataFrame) -> DataFrame:
    weights = term_ops.tfidf(terms, idf).select("file_name", "term", "weight")
    return rounded(weights, "weight")


def _tfidf_normalized(terms: DataFrame, idf: DataFrame) -> DataFrame:
    weights = term_ops.normalize(term_ops.tfidf(terms, idf))
    return rounded(weights.select("file_name", "term", "weight"), "weight")


def _similar_books(books: DataFrame) -> DataFrame:
    # Ranked on rounded cosines, so that rounding errors cannot reorder equal ones.
    return similarity.top_similar(rounded(analyses.cosines(books, TARGET), "cosine"))


def _similar_books_indexed(books: DataFrame) -> DataFrame:
    """The top of several targets from one stored index."""
    index = analyses.book_index(books)
    tops = []
    for target in TARGETS:
        top = similarity.top_similar(rounded(term_index.search(index, target).cosines, "cosine"))
        tops.append(top.select(F.lit(target).alias("target"), "rank", "file_name", "cosine"))
    return reduce(DataFrame.unionByName, tops)


def _books_from_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "books")
    write_books(_books(spark, folder), path)
    found = read_books(spark, path)
    return found.select("file_name", F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("digest"))


def _lines_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The texts as line files in two folders, read together: how often each line occurs."""
    paths = [new_path(spark, "lines") for _ in range(2)]
    texts = _documents(spark, folder).where(F.col("text").isNotNull())
    for half, path in enumerate(paths):
        texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).select("text").write.text(path)
    return read_lines(spark, paths).groupBy("value").agg(F.count("*").alias("occurrences"))


def _wordcount_written(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "counts")
    write_counts(wordcount.word_count(_documents(spark, folder), "clean", "text"), path)
    return read_counts(spark, path)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the ``llm`` subpackage and of the pipeline, unless they were removed."""
    try:
        import bookloom.llm.queries as llm
        import corpus_pipeline as pipeline
    except ModuleNotFoundError as error:
        if not (error.name or "").startswith(("bookloom.llm", "corpus_pipeline")):
            raise
        return {}, {}
    sql = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return llm.queries() | {"pipeline": pipeline.run}, llm.oracle_sql() | sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes ``(spark, sf_dir)``."""
    return _book_queries() | _training_data()[0]


def _book_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "book_metadata": _on_metadata(
            lambda md: md.select(
                "file_name", "title", "release_date", "language", "encoding", "release_year"
            ),
            "title",
            "release_date",
            "language",
            "encoding",
        ),
        "books_per_year": _on_metadata(stats.books_per_year, "release_date"),
        "missing_year_count": _on_metadata(stats.missing_year_count, "release_date"),
        "language_counts": _on_metadata(stats.language_counts, "language"),
        "top_language": _on_metadata(stats.top_language, "language"),
        "avg_title_length": _on_metadata(
            lambda md: rounded(stats.average_title_length(md), "average_title_length"), "title"
        ),
        "missing_metadata": _on_metadata(
            stats.missing_metadata, "title", "release_date", "language", "encoding"
        ),
        "total_books": _on_books(stats.total_books),
        "book_authors": _on_books(metadata.extract_authors),
        "valid_author_books": _on_books(_valid_books),
        "valid_author_count": _on_books(
            lambda books: _valid_books(books).agg(F.count("*").alias("valid_books"))
        ),
        "influence_edges": _on_network(influence.influence_edges),
        "influence_edge_count": _on_network(influence.edge_count),
        "influence_edge_sample": _on_network(influence.edge_sample),
        "out_degree": _on_network(influence.out_degree),
        "in_degree": _on_network(influence.in_degree),
        "top5_out_degree": _on_network(lambda n: influence.top_degree(influence.out_degree(n))),
        "top5_in_degree": _on_network(lambda n: influence.top_degree(influence.in_degree(n))),
        "clean_tokens": _on_books(term_ops.clean_tokens),
        "term_frequency": _on_books(_term_frequency),
        "vocabulary": _on_books(lambda books: term_ops.vocabulary(term_ops.book_terms(books))),
        "idf": _on_weights(lambda terms, idf: rounded(idf.select("term", "idf"), "idf")),
        "tfidf": _on_weights(_tfidf),
        "tfidf_normalized": _on_weights(_tfidf_normalized),
        "similar_books_top5": _on_books(_similar_books),
        "similar_books_indexed": _on_books(_similar_books_indexed),
        "book_similarity_pairs": _on_books(lambda books: analyses.book_pairs(books, MIN_COSINE)),
        "metadata_report": _on_books(lambda books: rounded(report.report(report.metadata_table(books)), "value")),
        "books_of_years": _on_books(
            lambda books: report.books_of_years(report.metadata_table(books), FIRST_YEAR, LAST_YEAR)
        ),
        "wordcount": _on_lines("clean"),
        "wordcount_whitespace": _on_lines("whitespace"),
        "books_from_files": _books_from_files,
        "lines_from_files": _lines_from_files,
        "wordcount_written": _wordcount_written,
    }


# --- the same results in SQL -----------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(_quoted(value) for value in values) + ")"


def _field(pattern: str) -> str:
    return f"trim(regexp_extract(text, {_quoted(pattern)}, 1))"


_YEAR = f"cast(nullif(regexp_extract(release_date, {_quoted(fixed.YEAR)}, 1), '') as integer)"

_STEPS = {
    "books": duckdb_statement(),
    "found": f"""
        select file_name, {_field(fixed.TITLE)} as title, {_field(fixed.RELEASE_DATE)} as release_date,
               {_field(fixed.LANGUAGE)} as named, {_field(fixed.ENCODING)} as encoding
        from books""",
    "md": f"""
        select file_name, title, release_date,
               case when named in {_listed(fixed.LANGUAGES)} then named end as language,
               encoding, {_YEAR} as release_year
        from found""",
    "named": f"""
        select file_name,
               coalesce(nullif({_field(fixed.AUTHOR_LABEL)}, ''), nullif({_field(fixed.AUTHOR_BY)}, ''),
                        nullif({_field(fixed.AUTHOR_BY_ALONE)}, '')) as author,
               {_field(fixed.RELEASE_DATE)} as release_date
        from books""",
    "authors": f"select file_name, author, release_date, {_YEAR} as release_year from named",
    "valid": f"""
        select file_name, author, release_year from authors
        where author is not null and trim(author) <> '' and release_year is not null
          and lower(trim(author)) not in {_listed(fixed.NOT_AUTHORS)}""",
    "edges": f"""
        select distinct a.author as author1, b.author as author2
        from (select distinct author, release_year from valid) a,
             (select distinct author, release_year from valid) b
        where a.author <> b.author
          and abs(a.release_year - b.release_year) <= {fixed.INFLUENCE_YEARS}""",
    "cleaned": f"""
        select file_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                 lower(text), {_quoted(fixed.BODY_START)}, '', 'g'), {_quoted(fixed.BODY_END)}, '', 'g'),
                 '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as body
        from books""",
    "tokens": f"""
        select file_name, term
        from (select file_name, unnest(string_split_regex(body, '\\s+')) as term from cleaned) t
        where term not in {_listed(fixed.STOP_WORDS)}""",
    "counts": "select file_name, term, count(*) as tf from tokens group by file_name, term",
    "vocabulary": f"""
        select term, count(*) as df, cast(sum(tf) as bigint) as cf from counts group by term
        having count(*) >= {fixed.MIN_BOOKS_PER_TERM}
        order by cf desc, term limit {fixed.VOCABULARY_SIZE}""",
    "tf": "select c.* from counts c join vocabulary v on c.term = v.term",
    "idf": """
        select term, ln((m + 1.0::double) / (df + 1.0::double)) as idf
        from vocabulary, (select count(*) as m from books) n""",
    "weights": """
        select file_name, tf.term as term, tf * idf as weight
        from tf join idf on tf.term = idf.term""",
    "norms": "select file_name, sqrt(sum(weight * weight)) as norm from weights group by file_name",
    "units": """
        select w.file_name as file_name, term, case when norm > 0 then weight / norm else 0 end as weight
        from weights w join norms n on w.file_name = n.file_name""",
}


def _with(steps: str, query: str) -> str:
    parts = [f"{name} as materialized ({_STEPS[name]})" for name in steps.split()]
    return f"with {', '.join(parts)} {query}" if parts else query


_MD = "books found md"
_AUTHORS = "books named authors"
_EDGES = f"{_AUTHORS} valid edges"
_COUNTS = "books cleaned tokens counts"
_IDF = f"{_COUNTS} vocabulary tf idf"
_UNITS = f"{_IDF} weights norms units"

_OUT = "select author1 as author, count(distinct author2) as degree from edges group by author1"
_IN = "select author2 as author, count(distinct author1) as degree from edges group by author2"
_TOP5 = " order by degree desc, author limit 5"


def _words(pieces: str) -> str:
    return f"""
        select word, count(*) as count
        from (select unnest(string_split_regex({pieces}, '[ \\t\\n\\r\\f]+')) as word from documents) t
        where word <> '' group by word order by word"""


def oracle_sql() -> dict[str, str]:
    """The SQL for DuckDB that must give the same rows as the query of the same name."""
    return _book_sql() | _training_data()[1]


def _book_sql() -> dict[str, str]:
    return {
        "book_metadata": _with(_MD, "select * from md"),
        "books_per_year": _with(
            _MD,
            """select release_year, count(*) as number_of_books from md
               where release_year is not null group by release_year""",
        ),
        "missing_year_count": _with(
            _MD, "select count(*) filter (where release_year is null) as missing_years from md"
        ),
        "language_counts": _with(
            _MD,
            """select language, count(*) as book_count from md
               where language is not null and trim(language) <> '' group by language""",
        ),
        "top_language": _with(
            _MD,
            """select language, count(*) as book_count from md
               where language is not null and trim(language) <> ''
               group by language order by book_count desc, language limit 1""",
        ),
        "avg_title_length": _with(
            _MD,
            """select round(avg(length(title)), 6) as average_title_length
               from md where title is not null and trim(title) <> ''""",
        ),
        "missing_metadata": _with(
            _MD,
            "select "
            + ", ".join(
                f"count(*) filter (where {name} is null or trim({name}) = '') as missing_{name}s"
                for name in ("title", "release_date", "language", "encoding")
            )
            + " from md",
        ),
        "total_books": _with("books", "select count(*) as total_books from books"),
        "book_authors": _with(_AUTHORS, "select * from authors"),
        "valid_author_books": _with(f"{_AUTHORS} valid", "select * from valid"),
        "valid_author_count": _with(
            f"{_AUTHORS} valid", "select count(*) as valid_books from valid"
        ),
        "influence_edges": _with(_EDGES, "select * from edges"),
        "influence_edge_count": _with(_EDGES, "select count(*) as total_edges from edges"),
        "influence_edge_sample": _with(
            _EDGES, "select * from edges order by author1, author2 limit 10"
        ),
        "out_degree": _with(_EDGES, _OUT),
        "in_degree": _with(_EDGES, _IN),
        "top5_out_degree": _with(_EDGES, _OUT + _TOP5),
        "top5_in_degree": _with(_EDGES, _IN + _TOP5),
        "clean_tokens": _with("books cleaned tokens", "select * from tokens"),
        "term_frequency": _with(f"{_COUNTS} vocabulary tf", "select * from tf"),
        "vocabulary": _with(f"{_COUNTS} vocabulary", "select * from vocabulary"),
        "idf": _with(_IDF, "select term, round(idf, 6) as idf from idf"),
        "tfidf": _with(
            f"{_IDF} weights", "select file_name, term, round(weight, 6) as weight from weights"
        ),
        "tfidf_normalized": _with(
            _UNITS, "select file_name, term, round(weight, 6) as weight from units"
        ),
        "similar_books_top5": _with(
            _UNITS,
            f"""select row_number() over (order by cosine desc, file_name) as rank, file_name, cosine
                from (select b.file_name as file_name, round(coalesce(dot, 0), 6) as cosine
                      from books b left join (
                        select u.file_name as file_name, sum(u.weight * t.weight) as dot
                        from units u join units t on u.term = t.term and t.file_name = '{TARGET}'
                        group by u.file_name) d on b.file_name = d.file_name
                      where b.file_name <> '{TARGET}'
                        and exists (select 1 from books where file_name = '{TARGET}')) s
                order by cosine desc, file_name limit {fixed.TOP_SIMILAR}""",
        ),
        "similar_books_indexed": _with(
            _UNITS,
            f"""select target, rank, file_name, cosine
                from (select target, file_name, cosine,
                             row_number() over (partition by target order by cosine desc, file_name) as rank
                      from (select g.file_name as target, b.file_name as file_name, round(coalesce(dot, 0), 6) as cosine
                            from (select file_name from books where file_name in {_listed(TARGETS)}) g
                            join books b on b.file_name <> g.file_name
                            left join (
                              select t.file_name as target, u.file_name as file_name, sum(u.weight * t.weight) as dot
                              from units u join units t on u.term = t.term and t.file_name in {_listed(TARGETS)}
                              group by t.file_name, u.file_name) d
                            on d.target = g.file_name and d.file_name = b.file_name) s) r
                where rank <= {fixed.TOP_SIMILAR}""",
        ),
        "book_similarity_pairs": _with(
            _UNITS,
            f"""select book_a, book_b, cosine
                from (select a.file_name as book_a, b.file_name as book_b,
                             round(sum(a.weight * b.weight), 6) as cosine
                      from units a join units b on a.term = b.term and a.file_name < b.file_name
                      group by a.file_name, b.file_name) p
                where cosine >= {MIN_COSINE}""",
        ),
        "metadata_report": _with(
            _MD,
            """select 'total_books' as measure, '' as name, count(*)::double as value from md
               union all select 'books_per_year', release_year::varchar, count(*) from md
                 where release_year is not null group by release_year
               union all select 'language_counts', language, count(*) from md
                 where language is not null and trim(language) <> '' group by language
               union all select 'missing_years', '', count(*) filter (where release_year is null) from md
               union all select 'average_title_length', '', round(avg(length(title)), 6) from md
                 where title is not null and trim(title) <> ''
            """
            + "".join(
                f"""union all select 'missing_{name}s', '', count(*) filter (where {name} is null or trim({name}) = '')
                    from md """
                for name in report.FIELDS
            ),
        ),
        "books_of_years": _with(
            _MD,
            f"""select file_name, title, release_date, language, encoding, release_year from md
                where release_year between {FIRST_YEAR} and {LAST_YEAR}""",
        ),
        "wordcount": _words("regexp_replace(text, '[^a-zA-Z0-9'']', ' ', 'g')"),
        "wordcount_whitespace": _words("text"),
        "books_from_files": _with(
            "books", "select file_name, length(text) as characters, md5(text) as digest from books"
        ),
        "lines_from_files": """
            select value, count(*) as occurrences
            from (select unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) as value from documents) t
            group by value""",
        "wordcount_written": _words("regexp_replace(text, '[^a-zA-Z0-9'']', ' ', 'g')"),
    }
