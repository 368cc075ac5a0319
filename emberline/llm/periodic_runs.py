"""Periodic runs: stretches of a text that repeat the same words over and over."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, pieces_of, table, text_or_empty

#: A run has this many words at least, and its period this many times.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Differences of word places that are held before they are counted; bounds memory.
HELD = 1 << 20
#: Words compared at once when a stretch of matches is followed, to begin with.
STEP = 64

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Words = list[bytes]


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many words equal the word `lag` places on, for each lag up to `most`; exact.

    A frequent word's matches at all lags are one autocorrelation by FFT; the
    power spectra of all of these are summed before the one transform back. The
    places of a rarer word are subtracted from each other, pair by pair, which
    costs less than a transform up to about sqrt(n log n) places.
    """
    counts = np.zeros(most + 1, dtype=np.int64)
    if most < 1:
        return counts
    size = 1 << int(len(ids) + most).bit_length()
    limit = max(8, int((size * size.bit_length() / 2) ** 0.5))
    order = np.argsort(ids, kind="stable")
    count = np.bincount(ids)
    end = np.cumsum(count)
    heavy = np.flatnonzero(count > limit)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            marks = np.zeros(size)
            marks[order[end[w] - count[w] : end[w]]] = 1
            f = np.fft.rfft(marks)
            power += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = count[ids[order]] <= limit
    stop = end[ids[order]]
    at = np.flatnonzero(light)
    held, n_held, k = [], 0, 1
    while True:
        at = at[at + k < stop[at]]
        if not len(at):
            break
        d = order[at + k] - order[at]
        near = d <= most
        at = at[near]  # places of a word ascend: a pair that is too far apart stays so for larger k
        held.append(d[near])
        n_held += len(held[-1])
        if n_held > HELD:
            counts += np.bincount(np.concatenate(held), minlength=most + 1)
            held, n_held = [], 0
        k += 1
    if held:
        counts += np.bincount(np.concatenate(held), minlength=most + 1)
    counts[0] = len(ids)
    return counts


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many places from the start on x and y agree."""
    done, step, n = 0, STEP, min(len(x), len(y))
    while done < n:
        differ = x[done : min(done + step, n)] != y[done : min(done + step, n)]
        if differ.any():
            return done + int(differ.argmax())
        done += len(differ)
        step *= 2
    return done


def islands(ids: np.ndarray, lag: int, need: int) -> Iterator[tuple[int, int]]:
    """Start and length of each maximal stretch of `need` or more places whose words equal those `lag` on.

    Such a stretch holds one of the places need - 1, 2 * need - 1, and so on; only
    around those of them that match are words compared.
    """
    seeds = np.arange(need - 1, len(ids) - lag, need)
    past = 0
    for i in seeds[ids[seeds] == ids[seeds + lag]].tolist():
        if i < past:
            continue
        back = _agreeing(ids[past : i + 1][::-1], ids[past + lag : i + lag + 1][::-1])
        ahead = _agreeing(ids[i:], ids[i + lag :])
        start, past = i + 1 - back, i + ahead
        if past - start >= need:
            yield start, past - start


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ids (small integers), by start, then period.

    A run of period q has length - q matches in a row at lag q, so lags with
    fewer matches in all are left out before any scan. A stretch that has period
    q and length 3 q but a smaller period too was found at that one before, with
    the same ends.
    """
    most = len(ids) // times
    if len(ids) < least:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(np.maximum(least, times * lags) - lags, 1)
    enough = lag_counts(ids, most) >= need
    enough[0] = False
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(enough).tolist():
        for start, matches in islands(ids, q, int(need[q])):
            found.setdefault((start, matches + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: all but those that a run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES, prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """Runs of every row of docs (doc_id, text), in one pass without a shuffle: doc_id, n_words, runs, best and collapsed.

    A run is a stretch of words with smallest period q, of `least` words and of
    `times` periods at least, that no neighbouring word extends; runs are ordered
    by start, then period. best is the one with the greatest length / period (ties:
    the first), null without runs. collapsed is the text of the words that no run
    contains after its first period, joined by one space. prepare(doc_id, words)
    may change a row's words (UTF-8) before.

    Null and empty texts have no words, no runs and an empty collapsed text.
    Repeated rows and null doc_ids are looked at like any other; an empty table
    gives no rows; other columns are ignored. A text is held whole, with about
    100 bytes for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole)):
            n_words, all_runs, best, collapsed = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = byte_words(text)
                words = prepare(doc_id, words) if prepare else words
                number: dict[bytes, int] = {}
                found = runs_of(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), least, times) if len(words) >= least else []
                kept = [words[i] for i in np.flatnonzero(kept_words(len(words), found))] if found else words
                top = best_of(found)
                n_words.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                best.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
                collapsed.append(b" ".join(kept).decode("utf-8"))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, words: Words) -> Words:
    """The words of op11's contract: in a tenth of the documents all words from one on repeat a stretch of the text; a document without an id is left as it is."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=planted)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
