"""Skewed, repeated and odd input gets the whole job: each test holds one finding of a review."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_dedup import plain_components
from tests.llm.test_tokens_packing import BYTES, WORDS, check_packing, ids_of
from weftmark.llm import packing, rans
from weftmark.llm.common import fresh_path
from weftmark.llm.components import connected_components
from weftmark.llm.labels import labelled_sample
from weftmark.llm.line_dedup import line_dedup
from weftmark.llm.simhash import fingerprint_links
from weftmark.llm.tokens import encoder

SPECIAL = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|><|startoftext|> \n b", "  <|startoftext|>É x<|endoftext|>\n", "<|ENDOFTEXT|> <|endoftext|"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_tokens_as_the_library_gives_them(path):
    t = Tokenizer.from_file(path)
    for text in SPECIAL:
        assert ids_of(encoder(path).ids(text)) == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_token_file_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    at = fresh_path(spark, "t")
    rans.write_token_file(docs, at, BYTES)
    file = {r.doc_id: (r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rans.read_token_file(spark, at).collect()}
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs, WORDS).collect()}
    for path, got in ((BYTES, file), (WORDS, packed)):
        t = Tokenizer.from_file(path)
        for doc_id, text in enumerate(SPECIAL):
            ids = [*t.encode(text, add_special_tokens=False).ids, 0]
            assert got[doc_id] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pieces_that_do_not_mix_stay_in_bounded_blocks(spark, monkeypatch):
    per_block, level = [], packing._pack_level

    def seen(items, capacity, blocks, number):
        per_block.append(items.count() / blocks)
        return level(items, capacity, blocks, number)

    monkeypatch.setattr(packing, "_pack_level", seen)
    small = np.random.default_rng(3).integers(1, 130, 300).clip(max=127).tolist()
    for lens in ([70] * 600, small + [81] * 300):
        pieces = spark.createDataFrame(list(enumerate(lens)), "uid long, length long")
        rows = pieces.join(packing.pack_pieces(pieces, 128, block_pieces=50), "uid").collect()
        assert sorted(r.uid for r in rows) == list(range(600))
        n = check_packing(rows, 128)
        plain = np.zeros(600, np.int64)
        sizes = np.array(lens)
        packing._best_fit(np.argsort(-sizes, kind="stable"), sizes, plain, [], 128, 0)
        assert n <= 1.05 * len(set(plain.tolist()))
    assert max(per_block) <= 50


def test_repeated_rows_are_one_document_for_line_dedup(spark):
    rows = [(1, "often\nalone")] * 12 + [(i, f"often\nown {i}") for i in range(2, 11)] + [(None, "no id")] * 10 + [(None, "few")] * 9
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted(
        [(1, "alone")] * 12 + [(i, f"own {i}") for i in range(2, 11)] + [(0, "")] * 10 + [(0, "few")] * 9)


def test_label_sample_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"copy {i % 2}") for i in range(40)] + [(i, "own") for i in range(2, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 8, 1, 5).select("doc_id", "y").collect()
    assert sorted(map(tuple, got)) == [(i, i % 2) for i in range(1, 9)]


@pytest.mark.parametrize("radius", [1, 3])
def test_odd_radius_links_wide_buckets(spark, radius):
    rng = np.random.default_rng(radius)
    fps = sorted({int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4))) for x in rng.integers(0, 2**62, 12) for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "simhash long")
    root = {r.node: r.root for r in connected_components(fingerprint_links(nodes, radius, max_bucket=2)).collect()}
    want = dict(zip(signed, (signed[i] for i in plain_components(list(enumerate(fps)), radius)), strict=True))
    same = lambda of: {frozenset(x for x in signed if of.get(x, x) == of.get(y, y)) for y in signed}
    assert same(root) == same(want)
