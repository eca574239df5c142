"""Books made from a ``documents`` table (``doc_id, text, lang, …``) by adding header lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

# One statement for two dialects, see ``spark_statement`` and ``duckdb_statement``.
_BOOKS = """
select concat(cast(doc_id as {S}), '.txt') as file_name, concat(
  case when doc_id % 11 = 3 then ''
       else concat('Title: Work ', repeat('x', cast(doc_id % 17 as int)), ' No ',
                   cast(doc_id as {S}), '  ', {N}) end,
  case when doc_id % 5 = 0 then concat('Author: ', nm, {N})
       when doc_id % 5 = 1 then concat('Authors : ', nm, ' ', {N})
       when doc_id % 5 = 2 then concat('by ', nm, {N})
       when doc_id % 5 = 3 then concat('By ', nm, ', editor', {N})
       when doc_id % 2 = 0 then concat('Author: Unknown', {N})
       else '' end,
  case when doc_id % 7 = 4 then ''
       when doc_id % 19 = 5
       then concat('Release Date: 12/25/91 [Etext #', cast(doc_id as {S}), ']', {N})
       else concat('Release Date: January 1, ', cast(1900 + (k*k) % 89 as {S}),
                   ' [EBook #', cast(doc_id as {S}), ']', {N}) end,
  case when doc_id % 13 = 6 then concat('Language: Volapuk', {N})
       else concat('Language: ', case lang when 'en' then 'English' when 'fr' then 'French'
                                           when 'de' then 'German' else 'Spanish' end, {N}) end,
  case when doc_id % 3 = 1 then '' else concat('Character set encoding: UTF-8', {N}) end,
  '*** START OF THIS PROJECT GUTENBERG EBOOK ', cast(doc_id as {S}), ' ***', {N}, text, {N},
  '*** END OF THIS PROJECT GUTENBERG EBOOK ', cast(doc_id as {S}), ' ***', {N}, 'licence') as text
from (select *, doc_id % 97 as k,
        concat('Auth', chr(cast(65 + (doc_id % 97) % 26 as int)), ' ',
               chr(cast(65 + (doc_id % 97) {DIV} 26 as int)), 'son') as nm
      from {documents}) d
"""


def books_from_documents(documents: DataFrame) -> DataFrame:
    """``file_name, text``: every document as a book with header lines and body markers."""
    statement = _BOOKS.format(S="string", N="chr(10)", DIV="DIV", documents="{documents}")
    return documents.sparkSession.sql(statement, documents=documents)


def duckdb_statement() -> str:
    """The same statement for DuckDB, over a view named ``documents``."""
    return _BOOKS.format(S="varchar", N="chr(10)", DIV="//", documents="documents")
