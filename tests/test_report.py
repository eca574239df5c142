"""The stored metadata table and the report from it."""

import pytest

from bookloom.operators import metadata, stats
from bookloom.plans import report


@pytest.fixture
def table(books, spark):
    texts = {}
    for i in range(300):
        year = "" if i % 10 == 3 else f"Release Date: May {1700 + i}\n"
        title = "" if i % 7 == 0 else f"Title: {'x' * (i % 5)} book\n"
        language = ("Language: English\n", "Language: French\n", "Language: Other\n", "")[i % 4]
        texts[f"{i}.txt"] = title + year + language + ("Character set encoding: X\n" if i % 3 else "")
    return books(texts).repartition(4)


def test_the_report_is_the_statistics(table):
    stored = report.metadata_table(table)
    md = metadata.extract_metadata(table)
    assert sorted(stored.collect()) == sorted(md.select(stored.columns).collect())
    found = {(r.measure, r["name"]): r.value for r in report.report(stored).collect()}
    want = {("total_books", ""): 300.0}
    want |= {("books_per_year", str(r.release_year)): r.number_of_books for r in stats.books_per_year(md).collect()}
    want |= {("language_counts", r.language): r.book_count for r in stats.language_counts(md).collect()}
    want[("missing_years", "")] = stats.missing_year_count(md).first()[0]
    want[("average_title_length", "")] = stats.average_title_length(md).first()[0]
    want |= {(name, ""): n for name, n in stats.missing_metadata(md).first().asDict().items()}
    assert found == pytest.approx(want)


def test_years_are_pushed_into_the_scan(spark, table, conf):
    conf("spark.sql.shuffle.partitions", "6")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = report.metadata_table(table)
    some = report.books_of_years(stored, 1750, 1760)
    assert sorted(r.release_year for r in some.collect()) == [y for y in range(1750, 1761) if (y - 1700) % 10 != 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(release_year,1750)" in plan and "LessThanOrEqual(release_year,1760)" in plan
    ranges = []
    for path in stored.inputFiles():
        low, high = spark.read.parquet(path).selectExpr("min(release_year)", "max(release_year)").first()
        ranges.append((low or 0, high or 0))
    ranges.sort()
    assert len(ranges) > 2 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_texts_are_not_read_again(table):
    stored = report.metadata_table(table)
    for df in (report.report(stored), report.books_of_years(stored, 1, 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan and "text#" not in plan


def test_no_books_and_an_existing_path(books, tmp_path):
    none = books({"a": "x"}).limit(0)
    found = {r.measure: r.value for r in report.report(report.metadata_table(none, f"{tmp_path}/t")).collect()}
    assert found["total_books"] == 0 and found["average_title_length"] is None
    with pytest.raises(Exception, match="exist"):
        report.metadata_table(none, f"{tmp_path}/t")
