import random

import numpy as np
from tokenizers import Tokenizer

from emberline.llm import token_files, word_bpe
from tests.llm.helpers import corpus, docs


def test_whole_table(spark, sf):
    t = Tokenizer.from_file(word_bpe.default_path())
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in corpus(sf).items()}
    rows = token_files.op1_separator_scan(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)


def test_scan_against_a_plain_split(spark, tmp_path):
    rng = random.Random(2)
    streams = {}
    for name in "abcdef":
        ids = [rng.choice([7, 7, 7, 1, 2]) if rng.random() < 0.9 else 9 for _ in range(rng.randrange(0, 400))]
        streams[name] = [x for x in ids] + ([9] if name in "ab" else [])
    streams["g"], streams["h"], streams["i"] = [9] * 20, [1] * 64, []
    for block in (1, 7, 64):
        rows = []
        for name, ids in streams.items():
            rows += [(name, i // block, bytearray(np.array(ids[i : i + block], dtype="<u2").tobytes())) for i in range(0, len(ids), block)]
        df = spark.createDataFrame(rows, "file string, block long, data binary").repartition(5)
        got = {}
        for r in token_files.scan_blocks(df, end_id=9).collect():
            got.setdefault(r.file, {})[r.ordinal] = (r.start, r.n_tokens)
        for name, ids in streams.items():
            want, at = [], 0
            for i, x in enumerate(ids):
                if x == 9:
                    want.append((at, i - at))
                    at = i + 1
            if at < len(ids):
                want.append((at, len(ids) - at))
            assert [got.get(name, {})[i] for i in sorted(got.get(name, {}))] == want, (name, block)
    path = tmp_path / "flat.bin"
    path.write_bytes(np.array(streams["a"], dtype="<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    flat = token_files.scan_blocks(token_files.flat_blocks(spark, str(tmp_path), block=16), end_id=9)
    assert flat.count() == streams["a"].count(9)


def test_odd_rows(spark):
    df = docs(spark, [(1, None), (1, None), (None, "a b"), (3, "word " * 100_000), (4, "")]).withColumnRenamed("lang", "file").repartition(2)
    rows = sorted((r.doc_id or 0, r.n_tokens) for r in token_files.token_counts(df).collect())
    assert rows == [(0, 2), (1, 0), (1, 0), (3, 100_000), (4, 0)]
    assert token_files.token_counts(docs(spark, [])).count() == 0


def test_sparse_file_above_two_gigabytes(spark, tmp_path):
    path, size = tmp_path / "large.bin", (1 << 31) + 10
    with open(path, "wb") as f:  # holes take no disk
        f.truncate(size)
        for place in (0, 7, 1 << 20, (1 << 30) + 3):
            f.seek(2 * place)
            f.write(np.array([9], "<u2").tobytes())
    blocks = token_files.flat_blocks(spark, str(path), block=1 << 22)
    got = sorted((r.ordinal, r.start, r.n_tokens) for r in token_files.scan_blocks(blocks, end_id=9).collect())
    assert got == [(0, 0, 0), (1, 1, 6), (2, 8, (1 << 20) - 8), (3, (1 << 20) + 1, (1 << 30) + 2 - (1 << 20)), (4, (1 << 30) + 4, 1)]
