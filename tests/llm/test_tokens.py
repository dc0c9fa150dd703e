"""Token files and packing: exact round trips against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from support import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from rootflow.llm import packing, token_file, tokens

ENCODER = tokens.Encoder(tokens.path())


def plain(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["", "A  b", "I'll don't 's", "İstanbul K", "éÅ é H̱", "a b c \x1c d\x85e", "<|endoftext|> x<|startoftext|>y.<|endoftext|>", "你好 ñandú ß ẞ", "̈a ...,!!! a1b2 ___ x.y.z it's, 'RE.'s", "ΑΣ ΟΔΟΣ.", "\x00a 😀 ﬁ", "Ⅷ ʰ ªº", "d.'D,'s", "İ. k İ,İ. \u0958. \u095f, x\u0958!", "\u2003 a\u2003.", "x" * 700 + ". " + "x" * 700]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.encode([text.encode()])[0].tolist() == plain(text)


LETTERS = [c for c in map(chr, range(0x110000)) if c.isalpha()]


@pytest.mark.parametrize("stop", ".,;:!?*%$#&")
def test_every_letter_before_a_stop(stop):
    some = [c for c in LETTERS if stop == "." or c < "\u3000"]
    for i in range(0, len(some), 20_000):
        text = " ".join(f"{c}{stop} a{c}{stop}b" if c < "\u3000" else f"{c}{stop}" for c in some[i : i + 20_000])
        assert ENCODER.encode([text.encode()])[0].tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbEé́.'s, \n\t1|<>*%ßİñ世\x1c\xa0"), max_size=40), max_size=6))
def test_any_texts(texts):
    assert [x.tolist() for x in ENCODER.encode([t.encode() for t in texts])] == [plain(t) for t in texts]


def test_forgetting_changes_nothing():
    small = tokens.Encoder(tokens.path(), remembered=3)
    texts = [f"some words number{i} and others{i % 3}." for i in range(20)]
    assert [small.encode([t.encode()])[0].tolist() for t in texts] == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([1, 7, 128, 512]), st.sampled_from([0.0, 50.0, 95.0, 100.0]))
def test_segments_round_trip(ids, block, percentile):
    a = np.array(ids, "<u4")
    s = token_file.Segment(token_file.pack_segment([5, None], [a, a[:3]], block, percentile))
    assert [(d, x.tolist()) for d, x in s.documents()] == [(5, ids), (None, ids[:3])]
    assert s.ids(2, 9).tolist() == (ids + ids[:3])[2:9]


def test_outliers_are_exceptions():
    a = np.full(512, 7, "<u4")
    a[100] = 40_000
    assert len(token_file.pack_block(a)) < 30


def test_token_files(spark, docs, no_docs, tmp_path):
    token_file.write_tokens(docs, f"file://{tmp_path}/t", segment_ids=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.read_tokens(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[0])
    rows = docs.collect()
    assert len(got) == len(rows) and [r[1] for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    want = defaultdict(list)
    for r in rows:
        ids = np.array([*plain(r.text), 1], "<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    at, seen = 0, defaultdict(list)
    for start, d, n, crc in got:
        assert start == at
        at += n
        seen[d].append((n, crc))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    token_file.write_tokens(no_docs, f"file://{tmp_path}/e")
    assert token_file.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_of_awkward_documents(docs, no_docs):
    rows = packing.pack(packing.pieces(docs)).collect()
    n = check_packing(rows, 4096)
    total = sum(r.length for r in rows)
    assert total == sum(len(plain(r.text)) + 1 for r in docs.collect()) and n == -(-total // 4096)
    assert {r.piece: r.length for r in rows if r.doc_id == 14} == {i: min(4096, 30_001 - 4096 * i) for i in range(8)}
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_packing_in_blocks_nears_the_bound(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 100, 900)]
    df = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, capacity=100, block_items=200).collect()
    assert check_packing(rows, 100) <= 1.03 * -(-sum(sizes) // 100) and len(rows) == 900
    again = packing.pack(df.repartition(5), capacity=100, block_items=200).collect()  # other files, the same packing
    assert {(r.doc_id, r.sequence_id, r.offset) for r in rows} == {(r.doc_id, r.sequence_id, r.offset) for r in again}


def test_lengths_that_nothing_fits(spark):
    df = spark.createDataFrame([(i, 0, 0, 60 if i % 50 else 100, 0) for i in range(300)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, capacity=100, block_items=50).collect()
    assert check_packing(rows, 100) == 300 == len(rows)


def test_genetic_steps_keep_every_item():
    import random

    rng = random.Random(3)
    size = [rng.randint(1, 60) for _ in range(80)]
    a, b = packing.first_fill(size, 100, rng, 0.0), packing.first_fill(size, 100, rng, 0.3)
    for c in (a, b, packing.crossover(a, b, size, 100, rng), packing.mutate(a, size, 100, rng), packing.evolve(size, 100, [a, b], 3, rng)[0]):
        assert sorted(i for x in c for i in x) == list(range(80)) and all(sum(size[i] for i in x) <= 100 for x in c)


def test_queries(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    ids = {r.doc_id: np.array([*plain(r.text), 1], "<u4") for r in docs}
    rows = packing.op10_best_fit_packing(spark, SF).collect()
    assert check_packing(rows, 4096) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1
    want = sorted((d, k, i, len(x[i : i + 4096]), zlib.crc32(x[i : i + 4096].tobytes())) for d, x in ids.items() for k, i in enumerate(range(0, len(x), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at, want = 0, []
    for d, x in ids.items():
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.op1_token_files(spark, SF).collect()) == want
