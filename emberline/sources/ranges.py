"""Ranges of large files, read by the tasks themselves."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file (its URI) and length of the files that Spark finds at a path; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def opened(uri: str) -> pa.NativeFile:
    """A file at a URI as Spark names it, open for reads at any place; schemes are those of pyarrow (file, hdfs, s3, gs, abfs)."""
    scheme, _, rest = uri.partition(":")
    if not rest.startswith("/"):
        return fs.LocalFileSystem().open_input_file(uri)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, at = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest)}")  # Spark names files unquoted
    return system.open_input_file(at)


def read(ranges: DataFrame) -> DataFrame:
    """ranges (file, at, size) with data, the bytes there; fewer at a file's end. A task holds one range at a time."""
    kind = [f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for batch in batches:
                columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c in ("file", "at", "size")}
                for i, (uri, at, size) in enumerate(zip(columns["file"], columns["at"], columns["size"], strict=True)):
                    if uri != name:
                        if file is not None:
                            file.close()
                        name, file = uri, opened(uri)
                    file.seek(at)
                    one = batch.slice(i, 1)
                    yield pa.record_batch([*one.columns, pa.array([file.read(size)], pa.binary())], names=[*batch.schema.names, "data"])
        finally:
            if file is not None:
                file.close()

    return ranges.mapInArrow(run, ", ".join([*kind, "data binary"]))
