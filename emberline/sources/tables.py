"""Reading and writing the engine's tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: list[str] = []
_RUN = uuid.uuid4().hex[:12]
_FOLDERS: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Reading order and types of the source tables.
STATIONS = "facilityname STRING, lat DOUBLE, lon DOUBLE, borough STRING"
NODES = "node_id BIGINT, x DOUBLE, y DOUBLE"
CLOSED_SITES = "name STRING, lat DOUBLE, lon DOUBLE"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this process where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/emberline-tables-{_RUN}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        holder = tempfile.TemporaryDirectory(prefix="emberline-")
        atexit.register(holder.cleanup)
        _OWN.append(holder.name)
    return _OWN[0]


def held(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and losing an executor costs no recomputation. The folder goes with the process."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, folder)
    path = f"{folder}/held-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of held() that nothing needs any longer: what was made of them is written itself."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            _delete(path)


def _delete(folder: str) -> None:
    """Deletes a folder by Spark's own file systems, while the JVM is there."""
    if SparkContext._gateway is not None:
        jvm = SparkContext._gateway.jvm
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except (Py4JError, OSError):  # at the end of the process, what is left is left
            return


def csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A CSV table with a header: strings unless a schema says otherwise, pruned to the wanted columns that exist, rows limited on demand."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return _pruned(df, columns, limit)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A Parquet table, pruned to the wanted columns that exist."""
    return _pruned(spark.read.parquet(path), columns, limit)


def _pruned(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> DataFrame:
    have = [c for c in columns if c in df.columns] if columns else []
    df = df.select(*have) if have else df
    return df.limit(limit) if limit else df


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, data) and edges (source, target, data) of a GraphML file; data maps keys to text."""
    data = T.StructField("data", T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())])))
    node = T.StructType([T.StructField("_id", T.StringType()), data])
    edge = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), data])
    pairs = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return read("node", node).select(F.col("_id").alias("id"), pairs), read("edge", edge).select(F.col("_source").alias("source"), F.col("_target").alias("target"), pairs)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes (id, data) and edges (source, target, data) as one GraphML document, in a folder of its own.

    All values are text, as graphml() reads them; those that are null are left
    out. The format is a single document, so one task writes the sorted lines;
    tables are the form for graphs too large for that.
    """
    def escaped(c):
        for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(mark))
        return c

    def element(tag: str, names: dict[str, str]):
        has = F.filter(F.map_entries("data"), lambda d: d["value"].isNotNull())
        data = F.transform(has, lambda d: F.concat(F.lit('<data key="'), escaped(d["key"]), F.lit('">'), escaped(d["value"]), F.lit("</data>")))
        attributes = [x for name, c in names.items() for x in (F.lit(f' {name}="'), escaped(F.col(c).cast("string")), F.lit('"'))]
        return F.concat(F.lit(f"<{tag}"), *attributes, F.lit(">"), F.coalesce(F.array_join(data, ""), F.lit("")), F.lit(f"</{tag}>")).alias("line")

    def keys(df: DataFrame, of: str) -> DataFrame:
        k = escaped(F.col("k"))
        named = df.select(F.explode(F.map_keys("data")).alias("k")).distinct()
        return named.select(F.lit(1).alias("at"), F.concat(F.lit('<key id="'), k, F.lit(f'" for="{of}" attr.name="'), k, F.lit('" attr.type="string"/>')).alias("line"))

    frame = nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, '<graph edgedefault="directed">'), (5, "</graph>\n</graphml>")], "at int, line string")
    lines = frame.unionByName(keys(nodes, "node")).unionByName(keys(edges, "edge"))
    lines = lines.unionByName(nodes.select(F.lit(3).alias("at"), element("node", {"id": "id"}))).unionByName(edges.select(F.lit(4).alias("at"), element("edge", {"source": "source", "target": "target"})))
    lines.repartition(1).sortWithinPartitions("at", "line").select("line").write.mode("overwrite").text(path)


def graphml_once(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The graph at path; where there is none, or its writing never ended, that of build(), written there first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or files.getFileStatus(at).isDirectory() and not files.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        write_graphml(*build(), path)
    return graphml(spark, path)


def excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A workbook's sheet, read on the driver by pandas where an Excel engine is installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes df whole, also if it has no rows, over what is there."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one a line, nested structs and nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
