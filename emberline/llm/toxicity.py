"""Toxicity: a bidirectional gated recurrent network over words and their characters, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, named, pieces_of, table, text_or_empty

#: Words of a window, and from one window's start to the next: each word is in two windows.
WINDOW, STRIDE = 32, 16
#: The classifier is fitted on so many labelled rows of each label at most.
TRAIN_ROWS = 1500
#: Rows whose crc32(doc_id) has remainder 0 are held out of training.
FOLDS = 5
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 6, 6, 4096
VOCABULARY = 60_000
#: A word is in the vocabulary if it is in more than one of so many training texts.
RARE = 400
EPOCHS, BATCH, RATE = 6, 128, 0.02
SEED = 17
#: One training row in so many teaches no weights but where 0.5 lies.
CALIBRATE = 4
#: Input projections of so many different words are kept by a worker.
KEPT_WORDS = 200_000

_EDGES = b"\"'()[]{}<>.,;:!?#*$%&|=/\\~`_+-"


def normal(word: bytes) -> bytes:
    """The word as the network sees it: lower case, without marks at its ends."""
    return word.lower().strip(_EDGES) or word


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for the three-byte grams of each word, edges marked, and where each word's begin."""
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size + 2) - (size + 2)
    gram = joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA6B) + joined[2:] * np.uint32(0xC2B2AE35)
    gram ^= gram >> np.uint32(15)
    real = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return (gram[real] % CHAR_ROWS).astype(np.int64), np.cumsum(size) - size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    words: dict[bytes, int]
    p: dict[str, np.ndarray]

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For normal words: rows of the word table, rows of the character table, and where each word's begin."""
        return (np.array([self.words.get(w, 0) for w in words], dtype=np.int64), *char_rows(words))

    def vectors(self, words: list[bytes]) -> np.ndarray:
        rows, grams, begin = self.inputs(words)
        count = np.diff(np.r_[begin, len(grams)])
        chars = np.add.reduceat(self.p["chars"][grams], begin, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][rows], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    k = HIDDEN
    g = h @ u
    zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), z, r, n, g[:, 2 * k :]


def forward(model: Model, at: np.ndarray, lengths: np.ndarray, projected: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows: at holds rows of `projected` (windows by WINDOW), real up to each window's length."""
    p, k = model.p, HIDDEN
    b, t = at.shape
    states = np.zeros((t, b, 2 * k), dtype=np.float32)
    ragged = bool(len(lengths)) and int(lengths.min()) < t
    for way, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
        h = np.zeros((b, k), dtype=np.float32)
        u, cols = p["Uf" if way == 0 else "Ub"], slice(3 * k * way, 3 * k * (way + 1))
        for i in order:
            x = projected[at[:, i], cols]
            new, z, r, n, g = _step(x, h, u)
            real = None
            if ragged:
                real = (lengths > i)[:, None]
                new = np.where(real, new, h)
            if keep is not None:
                keep.append((way, i, h, z, r, n, g, real))
            h = new
            states[i, :, k * way : k * (way + 1)] = h
    inner = np.tanh(states @ p["Wa"] + p["ba"])
    score = inner @ p["va"]
    if ragged:
        score = np.where(np.arange(t)[:, None] < lengths[None, :], score, np.float32(-1e9))
    score = score - score.max(axis=0)
    weight = np.exp(score)
    weight /= weight.sum(axis=0)
    if ragged:
        weight = weight * (lengths > 0)
    pooled = np.einsum("tb,tbk->bk", weight, states)
    logit = pooled @ p["wo"] + p["bo"][0]
    if keep is not None:
        keep.append((states, inner, weight, pooled))
    return logit


def gradients(model: Model, at: np.ndarray, lengths: np.ndarray, words: list[bytes], vectors: np.ndarray, projected: np.ndarray, target: np.ndarray, scale: np.ndarray) -> tuple[float, dict]:
    """Weighted cross-entropy of windows and its gradients, back through pooling, both directions and both inputs."""
    p, k, keep = model.p, HIDDEN, []
    b, t = at.shape
    logit = forward(model, at, lengths, projected, keep)
    states, inner, weight, pooled = keep.pop()
    prob = _sigmoid(logit)
    loss = float((scale * (np.logaddexp(0, logit) - target * logit)).sum() / b)
    d = (scale * (prob - target) / b).astype(np.float32)
    g = {name: np.zeros_like(v) for name, v in p.items() if name not in ("words", "chars")}
    g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
    d_pooled = d[:, None] * p["wo"]
    d_states = weight[:, :, None] * d_pooled[None]
    d_weight = np.einsum("tbk,bk->tb", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["va"] = np.einsum("tba,tb->a", inner, d_score)
    d_inner = (1 - inner**2) * d_score[:, :, None] * p["va"]
    g["Wa"] = np.einsum("tbk,tba->ka", states, d_inner)
    g["ba"] = d_inner.sum(axis=(0, 1))
    d_states = d_states + d_inner @ p["Wa"].T
    d_projected = np.zeros_like(projected)
    d_h = [np.zeros((b, k), dtype=np.float32) for _ in range(2)]
    for way, i, h, z, r, n, gn, real in reversed(keep):
        u = p["Uf" if way == 0 else "Ub"]
        d_new = d_states[i, :, k * way : k * (way + 1)] + d_h[way]
        stay = 0.0
        if real is not None:
            stay = np.where(real, np.float32(0), d_new)
            d_new = np.where(real, d_new, np.float32(0))
        d_z = d_new * (h - n) * z * (1 - z)
        d_n = d_new * (1 - z) * (1 - n**2)
        d_r = d_n * gn * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
        g["Uf" if way == 0 else "Ub"] += h.T @ d_g
        d_h[way] = d_new * z + d_g @ u.T + stay
        np.add.at(d_projected[:, 3 * k * way : 3 * k * (way + 1)], at[:, i], np.concatenate([d_z, d_r, d_n], axis=1))
    f, r_ = d_projected[:, : 3 * k], d_projected[:, 3 * k :]
    g["Wf"], g["bf"], g["Wb"], g["bb"] = vectors.T @ f, f.sum(axis=0), vectors.T @ r_, r_.sum(axis=0)
    d_vectors = f @ p["Wf"].T + r_ @ p["Wb"].T
    g["vectors"] = d_vectors
    return loss, g


def windows(n: int) -> list[tuple[int, int]]:
    """(start, length) of the overlapping windows of n words; one empty window without words."""
    if n <= WINDOW:
        return [(0, n)]
    return [(s, min(WINDOW, n - s)) for s in range(0, n - STRIDE, STRIDE)]


def _places(starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros((len(starts), WINDOW), dtype=np.int64)
    at = starts[:, None] + np.minimum(np.arange(WINDOW)[None, :], np.maximum(lengths - 1, 0)[:, None])
    return ids[np.minimum(at, len(ids) - 1)]


def train(texts: list[str], toxic: list[int], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fits the network on whole texts.

    A text is as toxic as its most toxic window. Each epoch scores all windows,
    then learns from each text's highest window and, of texts that aren't toxic,
    a second one by chance. The word table starts with the log odds of the
    words in the training texts. One text in CALIBRATE is left out of all that;
    these place the score of 0.5 where it parts them best.
    """
    kept = [i for i in range(len(texts)) if i % CALIBRATE]
    model = _learnt([texts[i] for i in kept], [toxic[i] for i in kept], seed, epochs)
    rest = [i for i in range(len(texts)) if not i % CALIBRATE]
    if rest:
        scorer = Scorer(model)
        logit = np.concatenate([scorer.logits([texts[i] for i in rest[k : k + 64]]) for k in range(0, len(rest), 64)])
        model.p["bo"] = (model.p["bo"] - _border(logit, np.array([toxic[i] for i in rest]))).astype(np.float32)
    return model


def _border(logit: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest range of borders that part two labels with the fewest errors; 0 where one label is missing."""
    if toxic.all() or not toxic.any():
        return 0.0
    order = np.argsort(logit, kind="stable")
    x, y = logit[order].astype(np.float64), toxic[order]
    # a border after the first k: toxic ones below it and clean ones above it are errors
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    errors = errors[1:-1]
    gap = np.diff(x)
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(gap[best])] if len(best) else 0
    return float((x[k] + x[k + 1]) / 2) if len(x) > 1 else 0.0


def _learnt(texts: list[str], toxic: list[int], seed: int, epochs: int) -> Model:
    """The network's weights after `epochs` rounds over the texts."""
    rng = np.random.default_rng(seed)
    label = np.array(toxic, dtype=np.float32)
    split = [[normal(w) for w in byte_words(t)] for t in texts]
    with_word = {}
    for words, y in zip(split, toxic, strict=True):
        for w in set(words):
            with_word.setdefault(w, [0, 0])[int(y)] += 1
    # rarer words stay unknown, as those of new texts will be
    rank = sorted((w for w, c in with_word.items() if sum(c) > 1 + len(texts) // RARE), key=lambda w: (-sum(with_word[w]), w))[:VOCABULARY]
    number = {w: i + 1 for i, w in enumerate(rank)}
    clean_n, toxic_n = max(1, len(toxic) - sum(toxic)), max(1, sum(toxic))
    odds = np.zeros(len(rank) + 1, dtype=np.float32)
    for w, i in number.items():
        c = with_word[w]
        odds[i] = np.log((c[1] + 0.5) / (toxic_n + 1)) - np.log((c[0] + 0.5) / (clean_n + 1))
    dims = WORD_DIM + CHAR_DIM

    def table_of(*shape: int, size: float) -> np.ndarray:
        return rng.normal(0, size, shape).astype(np.float32)

    p = {"words": table_of(len(rank) + 1, WORD_DIM, size=0.05), "chars": table_of(CHAR_ROWS, CHAR_DIM, size=0.03), "bo": np.array([-2.0], np.float32)}
    p["words"][:, 0] = np.clip(odds, -4, 4) / 2
    for way in "fb":
        p["W" + way], p["U" + way], p["b" + way] = table_of(dims, 3 * HIDDEN, size=0.4), table_of(HIDDEN, 3 * HIDDEN, size=0.3), np.zeros(3 * HIDDEN, np.float32)
        p["b" + way][:HIDDEN] = -0.5
    p["Wa"], p["ba"], p["va"], p["wo"] = table_of(2 * HIDDEN, HIDDEN, size=0.4), np.zeros(HIDDEN, np.float32), table_of(HIDDEN, size=0.4), table_of(2 * HIDDEN, size=0.4)
    model = Model(number, p)
    if not len(texts):
        return model
    vocab: dict[bytes, int] = {}
    ids = np.array([vocab.setdefault(w, len(vocab)) for words in split for w in words], dtype=np.int64)
    words = list(vocab) or [b"?"]
    rows, grams, begin = model.inputs(words)
    gram_count = np.diff(np.r_[begin, len(grams)]).astype(np.float32)
    first = np.cumsum([0, *map(len, split)])
    spans = [(d, first[d] + s, n) for d, own in enumerate(split) for s, n in windows(len(own))]
    doc, start, length = (np.array(x) for x in zip(*spans, strict=True))
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    # before the first epoch, a window counts as the odds of its words
    sums = np.r_[0.0, np.cumsum(np.maximum(odds[rows[ids]], 0))] if len(ids) else np.zeros(1)
    score = (sums[np.minimum(start + length, len(sums) - 1)] - sums[np.minimum(start, len(sums) - 1)]).astype(np.float32)
    moment = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in p.items()}
    steps = 0
    balance = np.where(label == 1, clean_n / toxic_n, 1.0).astype(np.float32) ** 0.5
    for epoch in range(epochs):
        if epoch:
            projected = model.project(model.vectors(words))
            score = np.concatenate([forward(model, _places(start[i : i + 8192], length[i : i + 8192], ids), length[i : i + 8192], projected) for i in range(0, len(doc), 8192)])
        order = np.lexsort((score, doc))
        top = order[np.r_[begins[1:], len(doc)] - 1]
        chance, other = (begins + (rng.random(len(begins)) * np.diff(np.r_[begins, len(doc)])).astype(np.int64) for _ in range(2))
        pick = np.concatenate([top, chance[label == 0], other[label == 0]])
        rng.shuffle(pick)
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for i in range(0, len(pick), BATCH):
            w = pick[i : i + BATCH]
            at = _places(start[w], length[w], ids)
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            # this batch's words alone
            size = gram_count[used].astype(np.int64)
            own_grams = np.repeat(begin[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            char = np.add.reduceat(p["chars"][grams[own_grams]], np.cumsum(size) - size, axis=0) / gram_count[used][:, None]
            vectors = np.concatenate([p["words"][rows[used]], char], axis=1)
            _, g = gradients(model, local, length[w], words, vectors, model.project(vectors), label[doc[w]], balance[doc[w]])
            d = g.pop("vectors")
            steps += 1
            for name, v in g.items():
                m, s = moment[name]
                m *= 0.9
                m += 0.1 * v
                s *= 0.999
                s += 0.001 * v * v
                p[name] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-6)
            for name, at_rows, v in (("words", rows[used], d[:, :WORD_DIM]), ("chars", grams[own_grams], (d[:, WORD_DIM:] / gram_count[used][:, None])[np.repeat(np.arange(len(used)), size)])):
                s = moment[name][1]
                some, inverse = np.unique(at_rows, return_inverse=True)
                v_sum = np.zeros((len(some), v.shape[1]), dtype=np.float32)
                np.add.at(v_sum, inverse, v)
                s[some] += v_sum * v_sum
                p[name][some] -= 2 * rate * v_sum / (np.sqrt(s[some]) + 1e-4)
    return model


class Scorer:
    """Scores texts by their most toxic window; input projections of words are kept between batches."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), dtype=np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        row = self.row
        new = [w for w in dict.fromkeys(words) if w not in row]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at = len(row)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part)] = self.model.project(self.model.vectors([normal(w) for w in part]))
            row.update(zip(part, range(at, at + len(part)), strict=True))
        return np.array([row[w] for w in words], dtype=np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts).astype(np.float64)))

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.row) > KEPT_WORDS:
            self._clear()
        split = [byte_words(t) for t in texts]
        ids = self._rows([w for words in split for w in words])
        first = np.cumsum([0, *map(len, split)])
        counts, starts, lengths = [], [], []
        for d, words in enumerate(split):
            n = len(words)
            if n <= WINDOW:
                s = np.array([0])
            else:
                s = np.arange(0, n - STRIDE, STRIDE)
            counts.append(len(s))
            starts.append(first[d] + s)
            lengths.append(np.minimum(WINDOW, n - s))
        start, length = np.concatenate(starts), np.concatenate(lengths)
        logit = np.empty(len(start), dtype=np.float32)
        whole = length == WINDOW
        for own in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(own), 4096):
                w = own[i : i + 4096]
                logit[w] = forward(self.model, _places(start[w], length[w], ids), length[w], self.table)
        return np.maximum.reduceat(logit, np.cumsum([0, *counts[:-1]]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most `rows` labelled documents of each label outside the held-out fold, chosen by a hash of doc_id.

    Where several documents have one doc_id, the least of their texts stands for them.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    learn = own.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    chosen = None
    for y in (0, 1):
        some = learn.where(F.col("toxic") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return met.orderBy("doc_id", "toxic")  # 2 * rows rows at most


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The network fitted on the driver, on a sample of at most 2 * rows documents."""
    data = training_rows(docs, labels, rows).select("text", "toxic").toPandas()
    return train(data["text"].tolist(), data["toxic"].tolist())


def score(docs: DataFrame, model: Model, kept: list[str] | None = None, into: str = "score") -> DataFrame:
    """kept (doc_id unless given) and the score (column `into`), from 0 to 1, of every row of docs, in one pass without a shuffle.

    All overlapping windows of the whole text are scored; the text's score is
    that of its most toxic window. Null and empty texts have one empty window
    and so all the same low score. Null doc_ids and repeated rows stay.
    """
    kept = kept or ["doc_id"]
    scored = _scored(docs, model, kept)
    return scored.toDF(*kept, into)


def _scored(docs: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """The columns kept under the names c0, c1, and so on, and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: VOCABULARY and CHAR_ROWS rows
    at = kept.index("text") if "text" in kept else len(kept)
    name = f"c{at}"
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], *([] if at < len(kept) else [text_or_empty().alias(name)]))
    schema = T.StructType(rows.schema.fields[: len(kept)]).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in (b for whole in batches for b in pieces_of(whole, name)):
            texts = [x.as_py() or "" for x in batch.column(at)]
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(scorer(texts))], names=schema.names)

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row of docs.

    labels (doc_id, toxic) are read for the training sample alone; rows with
    null or other labels aren't used. Without any labels all scores are low. An
    empty table gives no rows.
    """
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fit(docs, labels, rows))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that score under 0.5."""
    return _scored(docs, fit(docs, labels, rows), docs.columns).where("score < 0.5").drop("score").toDF(*docs.columns)


def op5_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
