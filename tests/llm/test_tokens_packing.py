"""Tokenizer cache, token files and packing: exact round trips and invariants."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from weftmark.llm import packing, queries, rans
from weftmark.llm.common import fresh_path
from weftmark.llm.tokens import encoder

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", "a  b", " a", "a ", "a \nb", "a\n b", "a\n\nb c\n", "it's don't I'LL we've", "x\x1cy \x1c z", "ª º ß İstanbul ΣΑΣ",
       "<|endoftext|> a<|endoftext|>b <|startoftext|>", "é é ñ", "日本 語", "1234 12a ab1 ,,, ... !!", "a\r\nb", "a.\nB ,c #x#\n|",
       "\n", "\n\n a", "a  \n  b", "😀 x😀y", "a\u0085b c\u0085 d", "Œuvre ÿ Ÿ ſ K", "w" * 100_000, "ªº µm aª, ÿ. ×y", "a\nb" * 30_000, "x\n\ny\n z\n" * 500]


def whole(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_equal_whole_encoding(path, spark):
    e = encoder(path)
    t = e.tokenizer
    for text in ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]:
        assert ids_of(e.ids(text)) == t.encode(text, add_special_tokens=False).ids

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet=" \n\t\x1c\xa0abzAZéÉß'.,!#1²ªсΣς́|<>", max_size=14) | st.text(max_size=12))
    def same(text):
        text = text.encode("utf-8", "ignore").decode()
        assert ids_of(e.ids(text)) == t.encode(text, add_special_tokens=False).ids

    same()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 400), st.integers(1, 70), st.integers(1, 40), st.integers(0, 2**31))
def test_rans_round_trip(n, symbols, lanes, every, seed):
    rng = np.random.default_rng(seed)
    alphabet = rng.choice(100_000, symbols, replace=False).astype(np.uint32)
    ids = alphabet[np.minimum(rng.geometric(0.1, n) - 1, symbols - 1)]
    seen, counts = np.unique(np.concatenate((alphabet, ids)), return_counts=True)
    freq = rans.quantised(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() >= 1
    docs = np.array([(1, 7, 0, 0, n, n), (0, 0, 1, 0, 0, 0)], rans.DOCUMENT)
    model = rans.Model(seen, freq)
    payload = rans.encode_block(ids, docs, model, lanes, every)
    got, back = rans.decode_block(payload, model)
    assert got.tolist() == ids.tolist() and back.tolist() == docs.tolist()
    spoilt = bytearray(payload)
    spoilt[len(payload) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(spoilt), model)


def test_quantised_extremes():
    assert rans.quantised(np.array([5])).tolist() == [1 << rans.SCALE_BITS]
    many = rans.quantised(np.concatenate(([10**12], np.ones(200_000))))
    assert many.sum() == 1 << rans.SCALE_BITS and many.min() == 1
    assert (rans.quantised(np.ones(1 << rans.SCALE_BITS)) == 1).all()


def expected_file(rows, path, end=0):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*whole(path, text or ""), end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op4_against_whole_encoding(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op4_rans_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected_file(rows, BYTES)


def test_token_file_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 64)
    rows = [(4, "a b c"), (None, "zz"), (2, None), (9, ""), (7, "long words here " * 300), (8, "x\n" * 40)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, start string")
    path = fresh_path(spark, "t")
    rans.write_token_file(df, path, BYTES)
    got = rans.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_file(rows, BYTES)
    empty = fresh_path(spark, "t")
    rans.write_token_file(df.limit(0), empty, BYTES)
    assert rans.read_token_file(spark, empty).count() == 0


def test_documents_cut_over_blocks(spark, monkeypatch):
    """Done in this process, as workers do not see changed module values."""
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(rans, "LONGEST_WHOLE", 120)
    import pyarrow as pa

    texts = [np.arange(n, dtype="<u4") % 17 for n in (3, 400, 0, 120, 121, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4, 5, 6]), pa.array([t.tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])
    model = rans.Model(np.arange(17), rans.quantised(np.ones(17)))
    monkeypatch.setattr(rans, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    blocks = [b for b in rans._blocks([batch], model, 4)]
    assert len(blocks) > 8
    parts = [r for b in rans._documents(blocks, model) for r in b.to_pylist()]
    for number, t in enumerate(texts):
        mine = sorted((p for p in parts if p["number"] == number), key=lambda p: p["first"])
        assert b"".join(p["ids"] for p in mine) == t.tobytes() and mine[0]["whole"] == len(t)
        assert mine[0]["before"] == sum(map(len, texts[:number])) and (len(mine) > 1) == (len(t) > 120)


def check_packing(rows, capacity):
    """Invariants of a packing; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_op5_pieces_and_sequences(spark):
    rows = queries.op5_pack_gga(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d in docs:
        ids = [*whole(WORDS, d.text or ""), 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want.add((d.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check_packing(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_over_levels_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    lens = [int(x) for x in rng.integers(1, 130, 900)] + [128] * 5
    pieces = spark.createDataFrame([(i, min(128, n)) for i, n in enumerate(lens)], "uid long, length long")
    rows = pieces.join(packing.pack_pieces(pieces, 128, block_pieces=100), "uid").collect()
    assert len(rows) == len(lens)
    assert check_packing(rows, 128) <= 1.03 * sum(min(128, n) for n in lens) / 128 + 1
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (None, "", 2), (3, "many words " * 3000, 3)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(odd, WORDS).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows if r.doc_id != 3 and r.doc_id) == [(1, 0, 1)] and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.length for r in rows if r.doc_id == 3) == 6001 and check_packing(rows, 2048) == 3
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_evolution_beats_or_equals_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for trial in range(5):
        lens = rng.integers(20, 70, 120).astype(np.int64)
        plain = np.zeros(len(lens), np.int32)
        packing._best_fit(np.argsort(-lens, kind="stable"), lens, plain, [], 100, 0)
        best = packing.evolve(lens, 100, [], trial, generations=30)
        assert packing._fitness(best, lens, 100) >= packing._fitness(packing._dense(plain), lens, 100)
        assert np.bincount(best, weights=lens).max() <= 100
        child = packing._crossover(best, packing._dense(plain), lens, 100, __import__("random").Random(trial))
        assert np.bincount(child, weights=lens).max() <= 100
