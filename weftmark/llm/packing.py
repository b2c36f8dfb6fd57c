"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document longer than a sequence is cut into full pieces and a rest; full pieces are
sequences of their own. The other pieces are dealt by hash to blocks of bounded size. Every
block lives on several islands, each with a population of groupings (piece -> bin). A crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates of them, and puts the displaced pieces back by best fit. After each epoch the
islands send their elite to the next island. Bins that end up badly filled are pooled
over blocks and packed again in fewer blocks of the same size, until one block is left or
a level settles under a tenth of its pieces; the bins of that level stay as they are.

Only (uid, length) takes part in the search, so the texts and ids are not shuffled for it.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import bucket_count, small_batches, staged
from weftmark.llm.tokens import BATCH_TEXTS, with_ids

CAPACITY = 2048
BLOCK_PIECES = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 8, 5
#: Blocks and islands that one task evolves; their rows are few but each takes a while.
TASK_HOMES = 16
#: Each level settles a tenth of its pieces at least, so what is left after these is next to nothing.
MOST_LEVELS = 100
#: A bin filled less than this is packed again with those of other blocks.
SETTLED_FILL = 0.98


def _best_fit(items, lens, bins, rooms, capacity: int, next_bin: int) -> None:
    """Put ``items`` one by one into the bin with the least room that holds them; ``bins`` is updated.

    ``rooms``: (room, bin) of the open bins. Bit r of ``free`` says that a bin has room r left.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for room, b in rooms:
        stacks[room].append(b)
        free |= 1 << room
    for i in items:
        size = int(lens[i])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, next_bin
            next_bin += 1
        bins[i] = b
        if room > size:
            stacks[room - size].append(b)
            free |= 1 << (room - size)


def _dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _fitness(bins: np.ndarray, lens: np.ndarray, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then more unequal fills."""
    fill = np.bincount(bins, weights=lens) / capacity
    return -len(fill), float(np.mean(fill * fill)) if len(fill) else 0.0


def _crossover(a: np.ndarray, b: np.ndarray, lens: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Well-filled bins of ``b`` go whole into ``a``; what they displace is put back by best fit."""
    fill = np.bincount(b, weights=lens)
    well = np.argsort(-fill)[:max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.sample(list(well), max(1, int(len(well) * rng.uniform(0.05, 0.4))))] = True
    injected = chosen[b]
    fill_a = np.bincount(a, weights=lens)
    gone = np.zeros(len(fill_a), bool)
    gone[a[injected]] = True
    gone[np.argsort(fill_a)[:rng.randint(1, 4)]] = True  # and the emptiest bins, as mutation
    child = a + len(fill)
    child[injected] = b[injected]
    displaced = np.flatnonzero(gone[a] & ~injected)
    kept = np.flatnonzero(~gone)
    rooms = [(int(capacity - fill_a[k]), int(k) + len(fill)) for k in kept if fill_a[k] < capacity]
    rooms += [(int(capacity - fill[k]), int(k)) for k in np.flatnonzero(chosen) if fill[k] < capacity]
    _best_fit(displaced[np.argsort(-lens[displaced], kind="stable")], lens, child, rooms, capacity, len(fill) + len(fill_a))
    return _dense(child)


def evolve(lens: np.ndarray, capacity: int, seeds: list[np.ndarray], seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> np.ndarray:
    """The best grouping (bin of each piece) found from ``seeds`` and from best-fit orders."""
    rng, bound = random.Random(seed), -(-int(lens.sum()) // capacity)
    order = np.argsort(-lens, kind="stable")
    people = list(seeds)
    while len(people) < population:
        bins = np.zeros(len(lens), np.int32)
        # the first is best-fit decreasing; others blur the order more and more
        blur = [0.0, 0.05, 0.2, 0.5, 1.0][len(people) % 5] if people else 0.0
        keys = lens * np.array([1 + blur * rng.uniform(-1, 1) for _ in range(len(lens))]) if blur else None
        _best_fit(order if keys is None else np.argsort(-keys, kind="stable"), lens, bins, [], capacity, 0)
        people.append(_dense(bins))
        if -_fitness(people[-1], lens, capacity)[0] == bound:
            return people[-1]
    rated = sorted(((_fitness(p, lens, capacity), i, p) for i, p in enumerate(people)), reverse=True)
    n = len(rated)
    for _ in range(generations):
        if -rated[0][0][0] == bound:
            break
        for _ in range(3):
            first, second = rng.sample(range(len(rated)), 2) if len(rated) > 1 else (0, 0)
            child = _crossover(rated[first][2], rated[second][2], lens, capacity, rng)
            n += 1
            rated.append((_fitness(child, lens, capacity), n, child))
        rated = sorted(rated, reverse=True)[:population]
    return rated[0][2]


def _islands(batches, capacity: int, epoch: int):
    for frame in batches:
        out = []
        for block, island, lens, elites in zip(frame["block"], frame["island"], frame["lens"], frame["elites"], strict=True):
            seeds = [np.frombuffer(e, np.int32) for e in elites]
            lens = np.asarray(lens, np.int64)
            bins = evolve(lens, capacity, seeds, hash((int(block), int(island), epoch)))
            full, ratio = _fitness(bins, lens, capacity)
            out.append((block, island, -full, ratio, bins.astype(np.int32).tobytes()))
        yield pd.DataFrame(out, columns=["block", "island", "n_bins", "ratio", "elite"])


_ELITE = "block long, island int, n_bins int, ratio double, elite binary"


def _placed(batches, capacity: int, level: int):
    """Best grouping of each block -> (uid, length, sequence_id, offset, settled: the bin is well filled)."""
    for frame in batches:
        for block, uids, lens, elite in zip(frame["block"], frame["uids"], frame["lens"], frame["elite"], strict=True):
            lens, bins = np.asarray(lens, np.int64), np.frombuffer(elite, np.int32)
            fill = np.bincount(bins, weights=lens).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lens[order])
            starts = ends - lens[order]
            first = np.concatenate(([0], np.cumsum(fill)[:-1]))
            ids = (level << 56) + (int(block) << 24) + bins[order].astype(np.int64)
            yield pd.DataFrame({"uid": np.asarray(uids, np.int64)[order], "length": lens[order], "sequence_id": ids,
                                "offset": starts - first[bins[order]], "settled": fill[bins[order]] >= SETTLED_FILL * capacity})


def _pack_level(items: DataFrame, capacity: int, blocks: int, level: int) -> DataFrame:
    grouped = staged(
        items.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "uid"), F.lit(blocks))).groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("p"))
        .select("block", F.col("p.uid").alias("uids"), F.col("p.length").alias("lens")), "blocks")
    homes = grouped.select("block", "lens", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    sent = None
    for epoch in range(EPOCHS):
        if sent is None:
            here = homes.withColumn("elites", F.array().cast("array<binary>"))
        else:
            own = sent.select("block", "island", F.col("elite").alias("own"))
            guest = sent.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
            here = homes.join(own, ["block", "island"]).join(guest, ["block", "island"]).withColumn("elites", F.array("own", "guest")).drop("own", "guest")
        here = here.repartition(bucket_count(blocks * ISLANDS, TASK_HOMES), "block", "island").select("block", "island", "lens", "elites")
        sent = staged(here.mapInPandas(lambda it, e=epoch: _islands(it, capacity, e), _ELITE), "elites")
    best = sent.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", -F.col("ratio"), "island")).alias("elite"))
    return staged(grouped.join(best, "block").mapInPandas(
        lambda it: _placed(it, capacity, level), "uid long, length long, sequence_id long, offset long, settled boolean"), "placed")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Staged (uid, length) -> (uid, sequence_id, offset); lengths lie in 1 … ``capacity``.

    A block holds about ``block_pieces`` pieces at every level.
    """
    full = pieces.filter(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, items, level = [full], pieces.filter(F.col("length") < capacity).select("uid", "length"), 0
    n = items.count()
    while n:
        blocks = bucket_count(n, block_pieces)
        placed = _pack_level(items, capacity, blocks, level)
        rest = placed.filter("not settled").count()
        # blocks are dealt by hash, so pieces that do not mix in theirs do not mix better in others
        last = blocks == 1 or rest > 0.9 * n or level == MOST_LEVELS
        done.append((placed if last else placed.filter("settled")).select("uid", "sequence_id", "offset"))
        items, n, level = placed.filter("not settled").select("uid", "length"), 0 if last else rest, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def document_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
                    capacity: int = CAPACITY) -> DataFrame:
    """Rows doc_id, piece, start, ids (binary) of whole texts, cut only where longer than ``capacity``.

    Null and empty texts are the end id alone. Repeated rows give repeated pieces.
    """
    ids = with_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", tokenizer, end_id).select("doc_id", "ids")
    n = F.greatest(F.octet_length("ids") - 1, F.lit(0))
    cuts = ids.select("doc_id", "ids", F.explode(F.sequence(F.lit(0), F.floor(n / (4 * capacity)).cast("int"))).alias("piece"))
    return cuts.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
                       F.substring("ids", F.col("piece") * (4 * capacity) + 1, F.lit(4 * capacity)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
                   capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every piece of every document is in exactly one sequence of at most ``capacity`` tokens, and
    a sequence's pieces follow one another without gaps from offset 0. Ties and repeated rows are
    pieces of their own; an empty table gives no rows; other columns are not read.
    """
    made = document_pieces(docs, tokenizer, id_col, text_col, end_id, capacity)
    made = made.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
                       *(["ids"] if keep_ids else []), F.monotonically_increasing_id().alias("uid"))
    with small_batches(docs.sparkSession, BATCH_TEXTS):
        pieces = staged(made, "pieces")
    return pieces.join(pack_pieces(pieces.select("uid", "length"), capacity), "uid").drop("uid")
