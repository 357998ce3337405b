"""Files out: one for each row, under a temporary name until it is whole, so that a repeated task leaves an equal file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI that Spark understands by a folder's name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file for each row of df(name, content) in a folder that all share; returns name and bytes. Rows with null content are left out.

    Names are single path parts; of rows with one name the file of the last one written stays.
    """
    uri = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            out = []
            for n, data in zip(pdf[name], pdf[content], strict=True):
                if data is None:
                    continue
                if not n or "/" in n or n.startswith("."):
                    raise ValueError(f"{n!r} is no file name")
                temporary = f"{path}/.{n}.{attempt}"
                with store.open_output_stream(temporary) as f:
                    f.write(data)
                store.move(temporary, f"{path}/{n}")
                out.append((n, len(data)))
            if out:
                yield pd.DataFrame(out, columns=["name", "bytes"])

    return df.select(name, content).mapInPandas(run, "name string, bytes long")
