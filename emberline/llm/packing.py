"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_bpe
from .common import table, text_or_empty

SEQUENCE = 2048
OPEN_BINS = 1024

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Bounded-space online best fit.

    At most `most` bins are open. A bitset has bit f set if some open bin has
    free space f; the lowest set bit from `length` on is the best fit. Where
    none fits and `most` bins are open, the fullest, the lowest set bit of all,
    closes for good; a piece that fills a bin alone needs no open one.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.held = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.held -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece and the piece's offset in it."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} in bins of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.held >= self.most and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.held += 1
        return b, self.capacity - free


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """Packs every row of docs (doc_id, text) into sequences of at most `sequence` tokens.

    A document is its word-BPE ids and then `end_id`. Documents longer than a
    sequence are cut into whole sequences and a rest; no other is cut. Each
    input partition packs its rows in one pass, in their order, with bounded
    memory (`open_bins` bins and one document's ids) and no shuffle; the size of Arrow
    batches changes nothing. A lost task is redone alone, with the same result
    as its rows and their order are those of the input files. Open bins of
    different partitions aren't merged.

    Null text counts as empty (one piece of length 1); very long texts are
    encoded in slices; null doc_id stays null; repeated rows are packed once
    each; an empty table gives no rows; other columns are ignored.
    """
    path = path or word_bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = word_bpe.loaded(path), OpenBins(sequence, open_bins)
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py(), end_id)
                for p, s in enumerate(range(0, len(ids), sequence)):
                    part = ids[s : s + sequence]
                    b, offset = bins.place(len(part))
                    for column, x in zip(out, (d, p, s, len(part), zlib.crc32(part), first + b, offset), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(v, pa.int32() if i == 1 else pa.int64()) for i, v in enumerate(out)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
