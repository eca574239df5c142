import os

import pytest
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from bookloom import sources
from bookloom.operators.wordcount import word_count
from bookloom.sources import staging


def put(folder, name, data):
    (folder / name).write_bytes(data)


def test_one_row_per_file(spark, tmp_path):
    put(tmp_path, "10.txt", b"Title: A\r\nline two\n")
    put(tmp_path, "a b.txt", b"x")
    put(tmp_path, "empty.txt", b"")
    put(tmp_path, "notes.md", b"not matched by the glob")
    rows = sources.read_books(spark, f"{tmp_path}/*.txt").collect()
    found = {row.file_name: row.text for row in rows}
    assert found["10.txt"] == "Title: A\r\nline two\n"
    assert found["a%20b.txt"] == "x"
    assert set(found) - {"empty.txt"} == {"10.txt", "a%20b.txt"}
    assert found.get("empty.txt", "") == ""


def test_other_extensions_have_no_name(spark, tmp_path):
    put(tmp_path, "notes.md", b"text")
    assert [r.file_name for r in sources.read_books(spark, str(tmp_path)).collect()] == [""]


def test_several_paths_of_books(spark, tmp_path):
    put(tmp_path, "1.txt", b"a")
    put(tmp_path, "2.txt", b"b")
    paths = [f"{tmp_path}/1.txt", f"{tmp_path}/2.txt"]
    assert sources.read_books(spark, paths).count() == 2


def test_line_ends(spark, tmp_path):
    put(tmp_path, "a.txt", b"one\ntwo\r\nthree\rfour")
    lines = [r.value for r in sources.read_lines(spark, f"{tmp_path}/a.txt").collect()]
    assert lines == ["one", "two", "three", "four"]


def test_lines_of_many_paths(spark, tmp_path):
    put(tmp_path, "a.txt", b"one\n")
    put(tmp_path, "b.txt", b"two\n")
    lines = sources.read_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])
    assert sorted(r.value for r in lines.collect()) == ["one", "two"]


def test_counts_are_written_as_tabbed_lines(spark, tmp_path):
    put(tmp_path, "a.txt", b"b a b\n")
    out = str(tmp_path / "out")
    counts = word_count(sources.read_lines(spark, f"{tmp_path}/a.txt"))
    sources.write_counts(counts, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a\t1", "b\t2"]
    with pytest.raises(AnalysisException):
        sources.write_counts(counts, out)


def test_staged_tables_go_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder.removeprefix("file:")))
    staged = sources.stage(spark.range(5), "numbers")
    new = set(os.listdir(folder.removeprefix("file:"))) - before
    assert len(new) == 1 and new.pop().startswith("numbers-")
    assert staged.count() == 5 and all(folder in path for path in staged.inputFiles())


def test_without_a_named_folder_the_warehouse_is_used():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "/house" if key == "spark.sql.warehouse.dir" else default

    assert staging.shared_folder(Session()) == "/house/_staged"


def test_a_scope_deletes_its_tables(spark):
    with sources.staging_scope(spark) as folder:
        staged = sources.stage(spark.range(5), "numbers")
        assert staged.count() == 5 and all(folder in path for path in staged.inputFiles())
    assert not os.path.exists(folder.removeprefix("file:"))


def test_counts_are_read_back(spark, tmp_path):
    put(tmp_path, "a.txt", b"b a b\n'\n")
    out = str(tmp_path / "out")
    sources.write_counts(word_count(sources.read_lines(spark, f"{tmp_path}/a.txt")), out)
    found = sources.read_counts(spark, out)
    assert found.dtypes == [("word", "string"), ("count", "bigint")]
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("b", 2), ("'", 1)}


def test_books_are_written_and_read_back(spark, books, tmp_path):
    texts = {"1.txt": "Title: A\r\n\rline\n", "2.txt": "", "a b.txt": "\u65e5\u672c \x00", "long.txt": "x" * 3_000_000}
    out = str(tmp_path / "books")
    assert sources.write_books(books(texts).repartition(3), out) == 4
    found = {r.file_name: r.text for r in sources.read_books(spark, out).collect()}
    assert found.pop("a%20b.txt") == texts.pop("a b.txt")
    assert found.get("2.txt", "") == texts.pop("2.txt")
    found.pop("2.txt", None)
    assert found == texts
    with pytest.raises(ValueError, match="exists"):
        sources.write_books(books({"3.txt": "x"}), out)
    assert not os.path.exists(f"{out}/3.txt")


@pytest.mark.parametrize("names", [["a.txt", "a.txt"], ["a/b.txt"], [None], [""]])
def test_names_that_are_no_files(spark, tmp_path, names):
    table = spark.createDataFrame([(n, "x") for n in names], "file_name string, text string")
    with pytest.raises(ValueError):
        sources.write_books(table, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_unfinished_books_are_not_read(spark, books, tmp_path):
    out = tmp_path / "books"
    sources.write_books(books({"1.txt": "x", "2.txt": None}), str(out))
    put(out, "_3.txt.0123", b"half of a te")
    assert {r.file_name for r in sources.read_books(spark, str(out)).collect() if r.text} == {"1.txt"}


def test_new_paths_are_in_the_scope(spark):
    assert sources.new_path(spark, "a").startswith(staging.shared_folder(spark))
    with sources.staging_scope(spark) as folder:
        assert sources.new_path(spark, "a").startswith(folder)
        assert sources.new_path(spark, "a") != sources.new_path(spark, "a")


def test_the_folder_of_books_is_listed_once(spark, tmp_path):
    rows = [(i, f"text {i}", "en") for i in range(50)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["books_from_files"](spark, str(tmp_path))
    assert found.count() == 50
    assert "InMemoryFileIndex(1 paths)" in found._jdf.queryExecution().executedPlan().toString()
