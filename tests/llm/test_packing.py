import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberline.llm import packing, word_bpe
from tests.llm.helpers import corpus, docs

ODD = ["", " ", "Σας ΟΔΟΣ İstanbul", "don't WE'RE 'tis ''s it's", "naïve café — “quoted” … €5", "１２ ³ ½ x²", "áb é", "東京 タワー", "\x1c\x85\xa0x​y", "<|endoftext|> a", "hi <|endoftext|> there", "<|ENDOFTEXT|>", "x<|startoftext|>y<|endoftext|>", "<|endoftext |>", "é<|endoftext|>東", "tab\tnew\nline\x0b\x0c\r\n", "ǅ ŉ ß ſ ı ﬁ", "x" * 5000, "🙂🙂 ok", "a_b-c+d=e"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(word_bpe.default_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(reference, sf):
    bpe = word_bpe.loaded(word_bpe.default_path())
    rng = random.Random(3)
    alphabet = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x250), *range(0x300, 0x320), *range(0x2010, 0x2028), 0x3A3, 0x3C2, 0x1F642]]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(1, 25))) for _ in range(4000)]
    for text in [*ODD, *made, *list(corpus(sf).values())[:60]]:
        assert bpe.encode(text) == reference(text), repr(text)


def test_literal_specials_and_slices(monkeypatch, reference, sf):
    t = Tokenizer.from_file(word_bpe.default_path())
    t.encode_special_tokens = True
    bpe = word_bpe.loaded(word_bpe.default_path(), literal=True)
    for text in ODD:
        assert bpe.encode(text) == t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(word_bpe, "SLICE", 40)
    bpe = word_bpe.loaded(word_bpe.default_path())
    for text in [*ODD, " ".join(ODD) * 3, "a" * 90 + " b" * 90, *list(corpus(sf).values())[:60]]:
        assert bpe.ids(text, 0).tolist() == [*reference(text), 0], repr(text)


def brute_best_fit(lengths, capacity, most):
    bins, out = [], []  # open bins as [number, free]
    made = 0
    for n in lengths:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            least = min(b[1] for b in fit)
            b = [x for x in bins if x[1] == least][-1]
        else:
            if len(bins) >= most and n < capacity:
                bins.remove(min(bins, key=lambda x: x[1]))
            b = [made, capacity]
            made += 1
            bins.append(b)
        out.append(capacity - b[1])
        b[1] -= n
        if not b[1]:
            bins.remove(b)
    return out, made


def test_bitset_agrees_with_a_plain_best_fit():
    rng = random.Random(5)
    for most in (1, 3, 40):
        lengths = [rng.choice([1, 2, 7, 50, 99, 100]) if rng.random() < 0.5 else rng.randrange(1, 101) for _ in range(3000)]
        bins = packing.OpenBins(100, most)
        got = [bins.place(n) for n in lengths]
        offsets, made = brute_best_fit(lengths, 100, most)
        assert [o for _, o in got] == offsets and bins.made == made


def test_pieces_are_whole_and_gapless(spark, sf, reference):
    texts = corpus(sf)
    rows = packing.op8_best_fit_packing(spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array([*reference(texts[d] or ""), 0], dtype="<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.length == 2048 or r.piece == len(own) - 1
            assert r.start == 2048 * r.piece and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_arrow_batches_change_nothing(spark, sf):
    want = sorted(packing.op8_best_fit_packing(spark, sf).collect())
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert sorted(packing.op8_best_fit_packing(spark, sf).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_sequences(spark, sf):
    """At most two hundredths more than the tokens need, but for what a partition leaves open."""
    rows = packing.pack(spark.read.parquet(f"{sf.rpartition('/')[0]}/sf0.01/documents.parquet").coalesce(1)).collect()
    bound = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= 1.02 * bound + 2


def test_odd_rows(spark):
    df = docs(spark, [(1, None), (1, None), (None, "a b"), (3, ""), (4, "word " * 3000)]).withColumnsRenamed({"lang": "piece"})
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (3, 0, 1), (4, 0, 2048), (4, 1, 953)]
    assert packing.pack(docs(spark, [])).count() == 0
