"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the
text's word shingles. Every bit position gets a non-zero vector of GF(2)^(r+1). Table v
keeps the positions whose vector has an odd product with v. Up to r differing positions span
at most r dimensions, so some v is orthogonal to all of them, and that table's mask leaves
them all out: each pair within radius r meets in at least one of the 2^(r+1) - 1 tables.

Only distinct fingerprints are hashed into tables. Within a bucket a search from unvisited
members links each group as a path, which keeps vertex degrees small. A bucket with more than
``MAX_BUCKET`` distinct fingerprints is never gathered: its members go through the words at
up to r/2 flips around them instead. Two fingerprints within r share such a word, and two that
share one are within r, so those links are exact as well and their number is linear. For an odd
r they meet at (r + 1)/2 flips, and the bits of those that share a word are counted.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import staged
from weftmark.llm.components import connected_components

BITS, SEED = 64, 42
MAX_BUCKET = 4096
BLOCK = 1 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """Masks of the 2^(radius+1) - 1 tables; vectors are dealt round robin so all masks weigh alike."""
    vectors = list(range(1, 1 << (radius + 1)))
    order = list(itertools.islice(itertools.cycle(vectors), BITS))
    random.Random(seed).shuffle(order)
    return [sum(1 << i for i, m in enumerate(order) if (m & v).bit_count() & 1) for v in vectors]


def _word_blocks(raw: bytes, k: int):
    """Word lists that overlap by k - 1 words, so that each shingle is in exactly one."""
    if len(raw) <= BLOCK:
        yield raw.lower().split()
        return
    carry, start = [], 0
    while start < len(raw):
        end = start + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carry + raw[start:end].lower().split()
        start = end
        if len(words) < k and start < len(raw):
            carry = words
            continue
        yield words
        carry = words[len(words) - k + 1:] if k > 1 else []


def fingerprint(raw: bytes | None, k: int) -> int:
    """Unsigned 64-bit SimHash of the text's k-word shingles (repeats count).

    Fewer words than ``k``: the whole sequence is the one shingle; no word or null: 0.
    """
    counts, n, digest = np.zeros(BITS, np.int64), 0, xxhash.xxh64_intdigest
    for words in _word_blocks(raw or b"", k):
        grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else (
            [b" ".join(words)] if words and not n else [])
        for some in itertools.batched((digest(g, SEED) for g in grams), 1 << 14):
            h = np.array(some, np.uint64)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else 0


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Add ``simhash`` (long, the 64 bits). An input column of that name is replaced."""
    @F.arrow_udf("long")
    def simhash(raw: pa.Array) -> pa.Array:
        return pa.array((_signed(fingerprint(t.as_py(), shingle)) for t in raw), pa.int64())  # one text at a time

    return docs.withColumn("simhash", simhash(F.col(text_col).cast("binary")))


def bucket_paths(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Path edges through each linked group of one bucket's distinct fingerprints (uint64)."""
    edges, rest = [], fps
    while len(rest) > 1:
        queue, rest, last = [rest[0]], rest[1:], rest[0]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            for x in rest[near]:
                edges.append((last, x))
                last = x
                queue.append(x)
            rest = rest[~near]
    return edges


def _bucket_links(batches, radius: int, most: int):
    """Rows sorted by (t, key) -> (a, b) path edges; (a, null) for each member of a wide bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    none = np.empty(0, np.uint64)
    held, held_id, wide = none, None, False

    def out(a, b=None):
        a = np.asarray(a, np.uint64).view(np.int64)
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.asarray(b, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), b], schema=schema)

    def closed(runs):
        edges = [e for run in runs if len(run) > 1 for e in bucket_paths(run, radius)]
        return out([a for a, _ in edges], [b for _, b in edges])

    for batch in batches:
        if not batch.num_rows:
            continue
        t, key, fp = (np.asarray(batch.column(c)) for c in ("t", "key", "simhash"))
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        ready = []
        if held_id == (t[0], key[0]):
            first = fp[:ends[0]]
            if wide:
                yield out(first)
            else:
                held = np.concatenate((held, first))
        else:
            if not wide:
                ready.append(held)
            held, wide = fp[:ends[0]], False
        if not wide and len(held) > most:
            yield out(held)
            held, wide = none, True
        held_id = (t[0], key[0])
        if len(starts) > 1:
            if not wide:
                ready.append(held)
            many = np.flatnonzero((ends - starts)[1:-1] > 1) + 1
            for i in many:
                run = fp[starts[i]:ends[i]]
                if len(run) > most:
                    yield out(run)
                else:
                    ready.append(run)
            held, held_id, wide = fp[starts[-1]:], (t[-1], key[-1]), False
            if len(held) > most:
                yield out(held)
                held, wide = none, True
        yield closed(ready)
    if not wide:
        yield closed([held])


def _set_links(batches, radius: int):
    """Rows with a set ``s`` of fingerprints -> (a, b) path edges through its groups within ``radius``."""
    for batch in batches:
        edges = [e for s in batch.column("s").to_pylist() for e in bucket_paths(np.array(s, np.int64).view(np.uint64), radius)]
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def fingerprint_links(fps: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Distinct ``simhash`` values -> edges (a, b) that connect all pairs within ``radius``."""
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)])).alias("cell")
    cells = (fps.select("simhash", tables).select("cell.t", "cell.key", "simhash")
             .repartition("t", "key").sortWithinPartitions("t", "key"))
    links = staged(cells.mapInArrow(lambda it: _bucket_links(it, radius, max_bucket), "a long, b long"), "links")
    wide = links.filter("b is null").select("a").distinct()
    edges = links.filter("b is not null")
    if not wide.head(1):
        return edges
    half = (radius + 1) // 2
    flips = [_signed(sum(1 << i for i in c)) for r in range(half + 1) for c in itertools.combinations(range(BITS), r)]
    around = F.explode(F.expr(f"array({', '.join(f'{x}L' if x > -(1 << 63) else '(-9223372036854775807L - 1L)' for x in flips)})"))
    ball = wide.select("a", around.alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("z"))
    # at most len(flips) fingerprints lie within ``half`` of a word, so the sets are small
    sets = ball.groupBy("z").agg(F.collect_set("a").alias("s")).filter("size(s) > 1")
    if radius % 2:  # two in a set may differ in radius + 1 bits
        return edges.unionByName(sets.select("s").mapInArrow(lambda it: _set_links(it, radius), "a long, b long"))
    paths = sets.select(F.explode(F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("a"),
                                               F.expr("slice(s, 2, size(s) - 1)").alias("b"))).alias("e"))
    return edges.unionByName(paths.select("e.a", "e.b"))


def _components(rows: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """Staged rows with ``simhash`` -> (simhash, root), a row for each distinct fingerprint."""
    nodes = staged(rows.select("simhash").distinct(), "nodes")
    roots = connected_components(fingerprint_links(nodes, radius, max_bucket))
    return staged(nodes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left")
                  .select("simhash", F.coalesce("root", "simhash").alias("root")), "roots")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: ``id_col``, ``simhash`` (long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits. Null
    ids are linked like others but never name a component unless all its ids are null (then
    null). Null and empty texts have fingerprint 0. Repeated rows stay repeated; an empty table
    gives no rows; other columns are not read.
    """
    rows = staged(with_fingerprint(docs.select(F.col(id_col), F.col(text_col)), text_col, shingle)
                  .select(id_col, "simhash"), "fingerprints")
    roots = _components(rows, radius, max_bucket)
    first = rows.groupBy("simhash").agg(F.min(id_col).alias("first_id"))
    named = staged(first.join(roots, "simhash"), "named")
    least = staged(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    ids = staged(named.select("simhash", "root").join(least, "root").select("simhash", "component_id"), "component")
    return rows.join(ids, "simhash").select(id_col, "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Keep exactly one row of each component: the one with the smallest id (nulls last).

    Of repeated rows with that id, one stays. All columns are returned unchanged.
    """
    names = docs.columns
    rows = staged(with_fingerprint(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]),
                                   f"c{names.index(text_col)}", shingle)
                  .withColumn("uid", F.monotonically_increasing_id()), "documents")
    roots = _components(rows, radius, max_bucket)
    key = f"c{names.index(id_col)}"
    first = staged(rows.groupBy("simhash").agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("i"), "uid")).alias("best")), "first")
    keep = first.join(roots, "simhash").groupBy("root").agg(F.min("best").alias("best")).select("best.uid")
    return rows.join(keep, "uid", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
