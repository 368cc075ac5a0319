"""What the corpus operators share: reading tables, cutting lineage, words."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether Spark deletes a query's shuffle files at its end, and not at some later collection on the driver.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RUN = uuid.uuid4().hex[:12]
_COUNT = itertools.count()
_OWN_BASE: list[str] = []
_FOLDERS: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this process in the one that driver and executors share: spark.checkpoint.dir. It goes with the process.

    Where the session names none (tests in one JVM), a temporary folder of this
    process stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = f"{base.rstrip('/')}/emberline-{_RUN}"
        if folder not in _FOLDERS:
            _FOLDERS.add(folder)
            atexit.register(_delete, folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_BASE:
        holder = tempfile.TemporaryDirectory(prefix="emberline-")
        atexit.register(holder.cleanup)
        _OWN_BASE.append(holder.name)
    return _OWN_BASE[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back.

    The lineage ends there: losing an executor later costs no recomputation of
    df, and Spark knows the size of what it reads, so that joins are broadcast
    only below spark.sql.autoBroadcastJoinThreshold. The shuffle files of the
    write are deleted as it ends; the table goes with forget(), or with the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{next(_COUNT):04d}-{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes the tables of cut() that nothing needs any longer: what was made of them is written itself."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            _delete(path)


def _delete(path: str) -> None:
    """Deletes a folder by Spark's own file systems; nothing where the JVM has gone already."""
    gateway = SparkContext._gateway
    if gateway is None:
        return
    jvm = gateway.jvm
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (Py4JError, OSError):  # at the end of the process, what is left is left
        return


def named(c: str):
    """The column of just this name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def whole_row(df: DataFrame):
    """All columns of df as one, so that no working column can have the name of one of them."""
    return F.struct(*map(named, df.columns))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def byte_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six bytes of WORD."""
    return text.encode("utf-8", "surrogatepass").split()


def pieces_of(batch: pa.RecordBatch, text_column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `budget` bytes, so that memory does not follow the batch's row count."""
    i = batch.schema.get_field_index(text_column)
    start, held = 0, 0
    lengths = pa.compute.binary_length(batch.column(i)).to_pylist()
    for k, n in enumerate(lengths):
        held += n or 0
        if held >= budget:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
