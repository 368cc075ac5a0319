"""Token counts of documents in flat token files, found by scanning for end-of-document ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.sources import ranges

from . import word_bpe
from .common import shared_dir, table, text_or_empty

#: Tokens of a block; a block is what one step of the scan reads.
BLOCK = 1 << 15
#: Blocks of a flat file that follow each other in a task.
RUN_OF_BLOCKS = 64
#: <|endoftext|> of the word-level vocabulary.
END = 49407

STREAM = "kind int, file int, block long, data binary, ordinal long, doc_ids array<long>"


def write_stream(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END, block: int = BLOCK) -> None:
    """Writes the ids of docs (doc_id, text) as flat streams of 16-bit little-endian ids, one file a partition, cut blindly into blocks.

    kind=0 rows are the blocks (the last of a file may be shorter). They say
    nothing about documents: each document's ids are followed by `end_id` and
    run across block edges. A separator that is spelt out in a text is encoded
    like other text. kind=1 rows keep the order in which doc_ids went in.
    """
    tokenizer = tokenizer or word_bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = word_bpe.loaded(tokenizer, literal=True), TaskContext.get().partitionId()
        schema = pa.schema([("kind", pa.int32()), ("file", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("ordinal", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        number = ordinal = 0
        held = bytearray()
        size = 2 * block

        def blocks(parts: list[bytes], order: list[int | None], first: int) -> pa.RecordBatch:
            n, m = len(parts), int(bool(order))
            return pa.record_batch([[0] * n + [1] * m, [file] * (n + m), [*range(number, number + n), *[None] * m], parts + [None] * m, [None] * n + [first] * m, [None] * n + [order] * m], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for x in part.column(1):
                    held += bpe.ids(x.as_py(), end_id).astype("<u2").tobytes()
                full = len(held) // size
                parts = [bytes(held[i * size : (i + 1) * size]) for i in range(full)]
                del held[: full * size]
                yield blocks(parts, part.column(0).to_pylist(), ordinal)
                number += full
                ordinal += part.num_rows
        if held:
            yield blocks([bytes(held)], [], ordinal)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows.mapInArrow(run, STREAM).write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(path)


def read_stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The blocks (file, block, data) and the order of documents (file, ordinal, doc_id) of a written stream."""
    rows = spark.read.schema(STREAM).parquet(path)
    order = rows.where("kind = 1").select("file", "ordinal", F.posexplode("doc_ids").alias("at", "doc_id"))
    return rows.where("kind = 0").select("file", "block", "data"), order.select("file", (F.col("ordinal") + F.col("at")).alias("ordinal"), "doc_id")


def flat_blocks(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks (file, block, data) of plain binary token files of any size; file is the path.

    Blocks are dealt to the session's shuffle partitions by their place, and
    read by the tasks (ranges.opened), one at a time. A file's last block may be
    shorter; empty files have none.
    """
    size = block * width
    files = ranges.listed(spark, path).where("length > 0")
    places = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    dealt = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", F.floor(F.col("block") / RUN_OF_BLOCKS))
    return ranges.read(dealt.select("file", "block", (F.col("block") * size).alias("at"), F.lit(size).cast("long").alias("size"))).select("file", "block", "data")


def scan_blocks(blocks: DataFrame, end_id: int = END, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, start, n_tokens of each document in blocks (file, block, data).

    Each block is searched for `end_id` on its own. A prefix scan over a file's
    blocks then gives each block the tokens and separators before it and the
    place of the last separator before it, so that a document that begins in an
    earlier block gets its whole length. A rest without a separator at a file's
    end is a document if it has tokens. Blocks with null data, and empty ones,
    have no tokens.
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, seps = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer() or b"", dtype=dtype)
                sizes.append(len(ids))
                seps.append(np.flatnonzero(ids == end_id).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(seps, pa.list_(pa.int64()))], names=["file", "block", "n", "seps"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.where(F.octet_length("data") >= width).select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, n long, seps array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block")
    base = found.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    marks = (
        base.withColumn("before", F.coalesce(F.sum(F.size("seps")).over(earlier), F.lit(0)).cast("long"))
        .withColumn("stop", F.coalesce(F.max(F.when(F.size("seps") > 0, F.col("base") + F.try_element_at("seps", F.lit(-1)))).over(earlier), F.lit(-1)))
        .withColumn("is_last", F.lead("block").over(later).isNull())
    )
    # all separators of a block as places in its file, after the last one before it
    tail = F.when(F.col("is_last") & (F.coalesce(F.try_element_at("seps", F.lit(-1)), F.lit(-1)) < F.col("n") - 1), F.array(F.col("n"))).otherwise(F.array().cast("array<long>"))
    ends = F.transform(F.concat("seps", tail), lambda x: x + F.col("base"))
    each = marks.where((F.size("seps") > 0) | F.col("is_last")).select("file", "before", F.concat(F.array("stop"), ends).alias("ends"))
    places = each.select("file", "before", "ends", F.posexplode(F.slice("ends", 2, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("i", "end"))
    start = F.element_at("ends", F.col("i") + 1) + 1
    return places.select("file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens (without the separator) of every row of docs (doc_id, text).

    The rows are written as flat token files to the shared folder, and counted
    by scanning these. Null and empty texts have 0 tokens; null doc_ids and
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    Very long texts are encoded in slices and span several blocks; what is held of one is its ids, two bytes each. The files go
    with the process, as the result is read from them.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_stream(docs, path, tokenizer)
    blocks, order = read_stream(spark, path)
    return scan_blocks(blocks).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
