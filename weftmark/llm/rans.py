"""Token files: ids under a static range asymmetric numeral system (rANS).

A file is a folder with two Parquet tables, so Spark's writers commit it and any store holds it:

* ``model``: (id, freq), the shared frequencies, which sum to 2^SCALE_BITS;
* ``blocks``: (shard, block, tokens_before, n_tokens, cut, payload). Shards follow the order of the
  documents, blocks that within a shard; ``cut`` marks blocks with part of a longer document.

A payload is independent of all others: a header, the documents' ids, places and lengths,
checkpoints, the 32-bit code words, and a CRC-32 of all that. The tokens are dealt to
``lanes`` interleaved 64-bit coder states, and every ``every`` steps a checkpoint holds all
states and the place in the words, so a reader decodes all checkpointed spans side by side.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm.common import small_batches, staged
from weftmark.llm.tokens import BATCH_TEXTS, encoder, with_ids

SCALE_BITS = 18
LANES, EVERY = 1024, 128
BLOCK_TOKENS = 1 << 18
#: Longer documents are cut over several blocks; all others are whole within one.
LONGEST_WHOLE = 1 << 20
LOW = np.uint64(1 << 31)
MAGIC = b"WRN1"
BLOCKS = "shard int, block long, tokens_before long, n_tokens long, cut boolean, payload binary"
HEAD = struct.Struct("<4sIIIIII")  # magic, tokens, lanes, every, documents, checkpoints, words
DOCUMENT = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("number", "<u8"), ("first", "<u8"), ("whole", "<u8"), ("n", "<u4")])


class Model:
    """Frequencies of the ids, and the tables for both directions."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.freq = ids[order].astype(np.uint32), freq[order].astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @functools.cached_property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))

    @functools.cached_property
    def places(self) -> np.ndarray:
        out = np.zeros(int(self.ids[-1]) + 1, np.uint32)
        out[self.ids] = np.arange(len(self.ids), dtype=np.uint32)
        return out


def quantised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^bits, near to the counts' shares."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError(f"{len(counts)} distinct ids exceed 2^{bits} slots")
    freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
    short = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if short > 0:
        freq[order[0]] += short
    for i in order:  # rounding up rare ids takes from the frequent ones
        if short >= 0:
            break
        cut = min(int(freq[i]) - 1, -short, max(1, int(freq[i]) // 8))
        freq[i] -= cut
        short += cut
    while short < 0:
        i = int(np.argmax(freq))
        cut = min(int(freq[i]) - 1, -short)
        freq[i] -= cut
        short += cut
    return freq


def encode_block(ids: np.ndarray, documents: np.ndarray, model: Model, lanes: int = LANES, every: int = EVERY) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 32))
    steps = -(-n // lanes)
    at = np.full(steps * lanes, int(np.argmax(model.freq)) if n else 0, np.uint32)
    at[:n] = model.places[ids]
    freq, cum = model.freq[at].reshape(steps, lanes), model.cum[at].reshape(steps, lanes)
    # with x = q * freq + r the next state is q * 2^bits + r + cum = x + q * (2^bits - freq) + cum
    rest, limit = np.uint64(1 << SCALE_BITS) - freq, freq << np.uint64(63 - SCALE_BITS)
    x, words, saved = np.full(lanes, LOW, np.uint64), [], []
    for s in range(steps - 1, -1, -1):
        over = np.flatnonzero(x >= limit[s])
        full = x[over]
        words.append(full.astype("<u4"))
        x[over] = full >> np.uint64(32)
        x = x + x // freq[s] * rest[s] + cum[s]
        if s % every == 0:
            saved.append((s, x))
            x = x.copy()
    words.reverse()
    before = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    marks = b"".join(struct.pack("<Q", int(before[s])) + x.astype("<u8").tobytes() for s, x in reversed(saved))
    code = b"".join(w.tobytes() for w in words)
    body = HEAD.pack(MAGIC, n, lanes, every, len(documents), len(saved), len(code) // 4) + documents.tobytes() + marks + code
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents) of a payload; a wrong checksum raises."""
    body = memoryview(payload)[:-4]
    if struct.unpack("<I", payload[-4:])[0] != zlib.crc32(body):
        raise ValueError("a token block's checksum is wrong")
    magic, n, lanes, every, n_docs, n_marks, n_words = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size
    documents = np.frombuffer(body, DOCUMENT, n_docs, at)
    at += documents.nbytes
    marks = np.frombuffer(body, "<u8", n_marks * (lanes + 1), at).reshape(n_marks, lanes + 1)
    at += marks.nbytes
    words = np.frombuffer(body, "<u4", n_words, at).astype(np.uint64)
    place, x = marks[:, 0].astype(np.int64).tolist(), marks[:, 1:].astype(np.uint64)
    steps = -(-n // lanes)
    out = np.zeros((n_marks * every, lanes), np.uint32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for s in range(min(every, steps)):
        live = n_marks if (n_marks - 1) * every + s < steps else n_marks - 1
        x = x[:live]
        slot = x & mask
        out[s:live * every:every] = at = model.slots[slot]
        x = model.freq[at] * (x >> bits) + slot - model.cum[at]
        low = x < LOW
        for span in range(live):
            lanes_low = np.flatnonzero(low[span])
            end = place[span] + len(lanes_low)
            x[span, lanes_low] = (x[span, lanes_low] << np.uint64(32)) | words[place[span]:end]
            place[span] = end
    return model.ids[out.reshape(-1)[:n]] if n else np.empty(0, np.uint32), documents


def _ids(column, width: int) -> np.ndarray:
    """All ids of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), f"<u{width}")


def _counts(batches, width: int):
    total = np.zeros(0, np.int64)
    for batch in batches:
        some = np.bincount(_ids(batch.column("ids"), width))
        if len(some) > len(total):
            total, some = some, total
        total[:len(some)] += some
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def _blocks(batches, model: Model, width: int):
    """Rows (doc_id, ids) in file order -> block rows of this task's shard."""
    shard = TaskContext.get().partitionId()
    held, docs, size, number, block, before = [], [], 0, 0, 0, 0

    def closed():
        nonlocal held, docs, size, block, before
        cut = any(d[4] > LONGEST_WHOLE for d in docs)
        payload = encode_block(np.concatenate(held) if held else np.empty(0, np.uint32), np.array(docs, DOCUMENT), model)
        row = pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "tokens_before": before, "n_tokens": size, "cut": cut, "payload": payload}], schema=schema)
        before, block, held, docs, size = before + size, block + 1, [], [], 0
        return row

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("cut", pa.bool_()), ("payload", pa.binary())])
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(raw, f"<u{width}")
            step = BLOCK_TOKENS if len(ids) > LONGEST_WHOLE else max(1, len(ids))
            for first in range(0, max(1, len(ids)), step):
                part = ids[first:first + step]
                held.append(part)
                docs.append((doc_id is not None, doc_id or 0, number, first, len(ids), len(part)))
                size += len(part)
                if size >= BLOCK_TOKENS:
                    yield closed()
            number += 1
    if docs:
        yield closed()


def write_token_file(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> None:
    """Write the ids of every whole text to a token file at ``path`` in ascending order of the id.

    Null ids come first, and repeated ids stay next to each other. A null or empty text has the
    end id alone. An empty table gives a file without blocks. Other columns are not read. The format
    holds ids of documents as 64-bit integers; a column of another type is an error.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; a token file holds integer ids")
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else 4
    with small_batches(docs.sparkSession, BATCH_TEXTS):
        tokens = staged(with_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", tokenizer, end_id, width)
                        .select("doc_id", F.monotonically_increasing_id().alias("uid"), "ids"), "tokens", "zstd")
    counts = tokens.select("ids").mapInArrow(lambda it: _counts(it, width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.orderBy("id").toPandas()  # at most a row for each id of the tokenizer
    ids, freq = found["id"].to_numpy(), quantised(found["n"].to_numpy()) if len(found) else found["n"].to_numpy()
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq, strict=True)], "id long, freq long").coalesce(1).write.parquet(f"{path}/model")
    model = Model(ids, freq)
    (tokens.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid").select("doc_id", "ids")
     .mapInArrow(lambda it: _blocks(it, model, width), BLOCKS)
     .write.parquet(f"{path}/blocks"))


def _documents(batches, model: Model):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, docs = decode_block(row["payload"], model)
            ends = np.cumsum(docs["n"], dtype=np.int64)
            starts = ends - docs["n"]
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(docs), row["shard"], np.int32)),
                pa.array(docs["number"].astype(np.int64)),
                pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0),
                pa.array(row["tokens_before"] + starts),
                pa.array(docs["first"].astype(np.int64)),
                pa.array(docs["whole"].astype(np.int64)),
                pa.array([raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ], names=["shard", "number", "doc_id", "before", "first", "whole", "ids"])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/model").toPandas()
    model = Model(rows["id"].to_numpy(), rows["freq"].to_numpy()) if len(rows) else None
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # a row for each writing task, so the running total is short
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, total = [], 0
    for r in shards:
        starts.append((r.shard, total))
        total += r.n
    first = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))

    def decoded(some: DataFrame) -> DataFrame:
        parts = some.select("shard", "tokens_before", "payload").mapInArrow(
            lambda it: _documents(it, model), "shard int, number long, doc_id long, before long, first long, whole long, ids binary")
        return parts.join(first, "shard").withColumn("start", F.col("shard_start") + F.col("before"))

    cut = F.col("whole") > LONGEST_WHOLE
    some_cut = staged(decoded(blocks.filter("cut")), "cut-blocks")
    joined = some_cut.filter(cut).groupBy("shard", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.first("whole").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", F.hex("ids").alias("ids")))).alias("p"))
    joined = joined.withColumn("ids", F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")))
    names = ["doc_id", "start", "n_tokens", "ids"]
    whole = decoded(blocks.filter("not cut")).unionByName(some_cut).filter(~cut).withColumnRenamed("whole", "n_tokens")
    return whole.select(names).unionByName(joined.select(names))
