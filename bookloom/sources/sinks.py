"""Text-file sinks."""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The writer travels with the task, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_counts(counts: DataFrame, path: str) -> None:
    """Write ``word<TAB>count`` part files; an existing path is an error."""
    line = F.concat_ws("\t", F.col("word"), F.col("count").cast("string"))
    counts.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_books(books: DataFrame, path: str) -> int:
    """Write every row of ``file_name, text`` as a file of that name in a new folder; returns how many.

    Files are written by the tasks that hold the texts, through Arrow's file systems, so ``path`` has to
    be in storage that Arrow and all executors reach. A file gets its name when it is complete, so a
    task that is run again, or twice, leaves one file with the same text. Names must be different,
    not null and without ``/`` (else ValueError, before anything is written); a null text gives an
    empty file. An existing path is an error.
    """
    spark = books.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(folder):
        raise ValueError(f"{path} exists")
    name = F.coalesce(F.col("file_name"), F.lit("/"))
    wrong = books.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    wrong = wrong.where((F.col("n") > 1) | F.contains("name", F.lit("/")) | (F.col("name") == "")).limit(1).collect()
    if wrong:
        raise ValueError(f"not a name of one file: {wrong[0]['name']!r}")
    system.mkdirs(folder)
    uri = system.makeQualified(folder).toString()
    uri = uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri

    def write(batches):
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for i in range(len(batch)):
                name, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                unfinished = f"{base}/_{name}.{uuid.uuid4().hex}"  # readers pass over such names
                with store.open_output_stream(unfinished) as out:
                    out.write(text.encode("utf-8"))
                store.move(unfinished, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    written = books.select("file_name", "text").mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
