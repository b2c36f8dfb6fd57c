"""Benchmark decontamination: suffix arrays of the training words, searched with every test suffix.

Tasks cut their documents into shards of about ``SHARD_WORDS`` words and build a suffix array of
each. Words that no test text holds can be part of no match, so they end a suffix just as the end
of a document does, and have no suffixes of their own. Every suffix of every test text is looked
up by binary search. The longer of its common prefixes with the two neighbours of its place is the
longest verbatim match in the shard; where that reaches a window, the places that share the window
are one interval of the array, which gives all its locations.

The test texts reach the tasks in blocks of at most ``BLOCK_WORDS`` words, each broadcast for one
pass over the documents; a pass adds to the spans and items that the passes before it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import staged

SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
#: Test texts are cut into pieces of so many words, which overlap by a window less one word.
PIECE_WORDS = 1 << 15
WIDE = 8  # words compared at a time

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
FOUND = [("n_words", pa.int64()), ("longest", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))]
FOUND_DDL = "n_words long, longest long, spans array<struct<start:long,length:long>>, items array<string>"

#: Letters, digits and every character beyond ASCII make words; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _bounds(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class TestTexts:
    """Pieces of test texts as one array of word codes with a 0 after each, and their windows."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str, list[bytes], bool]], window: int):
        """``pieces``: (item, words, whether the piece is a whole item)."""
        self.vocabulary: dict[bytes, int] = {}
        name = self.vocabulary
        self.items = sorted({item for item, _, _ in pieces})
        number = {item: k for k, item in enumerate(self.items)}
        codes, item_at, left, length = [], [], [], []
        for item, words, whole in pieces:
            n = len(words)
            codes += [name.setdefault(w, len(name) + 1) for w in words] + [0]
            item_at += [number[item]] * (n + 1)
            left += [*range(n, -1, -1)]
            if n < window:
                length += [n if whole else 0] + [0] * n
            else:
                length += [window] * (n - window + 1) + [0] * window
        self.codes = np.array(codes + [0] * WIDE, np.int32)
        self.left, self.item_at = np.array(left, np.int64), np.array(item_at, np.int64)
        self.suffixes = np.flatnonzero(self.left)
        # windows of equal words are one: number, a place of it, and its items
        length = np.array(length, np.int64)
        at = np.flatnonzero(length)
        same: dict[tuple[int, bytes], int] = {}
        of = np.array([same.setdefault((int(n), self.codes[i:i + n].tobytes()), len(same)) for i, n in zip(at, length[at], strict=True)], np.int64)
        self.window_place, self.window_length = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
        self.window_place[of], self.window_length[of] = at, length[at]
        pairs = np.unique(np.stack([of, self.item_at[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.window_items = pairs[:, 1]
        self.window_items_at = np.searchsorted(pairs[:, 0], np.arange(len(same) + 1))

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Codes of a document's words; 0 for words that no test text holds."""
        code = self.vocabulary.get
        return np.fromiter((code(w, 0) for w in words), np.int32, len(words))


class Shard:
    """Documents' words as codes of the test vocabulary, 0 for other words and after each document."""

    def __init__(self, codes: np.ndarray, vocabulary: int):
        self.codes = np.concatenate([codes, np.zeros(WIDE, np.int32)])
        self.places = self._sorted(vocabulary)

    def _sorted(self, vocabulary: int) -> np.ndarray:
        """The suffix array, by prefix doubling; suffixes end before the next 0."""
        codes = self.codes
        at = np.flatnonzero(codes)
        if not len(at):
            return at
        ends = np.flatnonzero(codes == 0)
        rest = ends[np.searchsorted(ends, at)] - at  # words of each suffix
        bits = max(1, int(vocabulary).bit_length())
        depth = max(1, min(WIDE, 62 // bits))
        key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for d in range(depth):
            word = codes[at + d]
            alive = alive & (word > 0)
            key = (key << bits) | np.where(alive, word, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        # a suffix's rank is the first place of its group in the order
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        rank = np.zeros(len(codes), np.int64)
        rank[at[order]] = first + 1
        while True:
            new = np.append(fresh[1:], True)
            open_ = np.flatnonzero(~(fresh & new))  # members of groups of two or more
            if not len(open_):
                break
            who = order[open_]
            longer = rest[who] > depth
            second = np.where(longer, rank[np.minimum(at[who] + depth, len(codes) - 1)], 0)
            sub = np.lexsort((second, first[open_]))
            order[open_] = who[sub]
            group, second = first[open_][sub], second[sub]
            split = np.ones(len(open_), bool)
            split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            if not (split & ~fresh[open_]).any():
                break
            fresh[open_] = split
            first[open_] = np.maximum.accumulate(np.where(split, open_, 0))
            rank[at[order[open_]]] = first[open_] + 1
            depth *= 2
        return at[order]

    def search(self, test: np.ndarray, query: np.ndarray, limit: np.ndarray, past: bool = False):
        """(first place at or after each query, its common words before it, and after it).

        A query is the words of ``test`` from ``query`` on, ``limit`` of them. ``past`` takes the
        suffixes that begin with the whole query as being before it.
        """
        wide = np.arange(WIDE)
        low, high = np.full(len(query), -1), np.full(len(query), len(self.places))
        low_same, high_same = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        while True:
            live = np.flatnonzero(high - low > 1)
            if not len(live):
                return high, low_same, high_same
            mid = (low[live] + high[live]) // 2
            place = self.places[mid]
            same, go = np.minimum(low_same[live], high_same[live]), np.arange(len(live))
            while len(go):
                a = self.codes[(place[go] + same[go])[:, None] + wide]
                b = test[(query[live[go]] + same[go])[:, None] + wide]
                equal = np.logical_and.accumulate((a == b) & (b > 0), axis=1).sum(1)
                same[go] = np.minimum(same[go] + equal, limit[live[go]])
                go = go[(equal == WIDE) & (same[go] < limit[live[go]])]
            whole = same == limit[live]
            before = np.where(whole, past, self.codes[place + same] < test[query[live] + same])
            low[live], low_same[live] = np.where(before, mid, low[live]), np.where(before, same, low_same[live])
            high[live], high_same[live] = np.where(before, high[live], mid), np.where(before, high_same[live], same)

    def longest(self, tests: TestTexts):
        """For every test suffix: words of its longest match here, and a place of one."""
        q = tests.suffixes
        at, before, after = self.search(tests.codes, q, tests.left[q])
        near = np.where(after >= before, np.minimum(at, max(0, len(self.places) - 1)), at - 1)
        return np.maximum(before, after), self.places[np.maximum(near, 0)] if len(self.places) else np.zeros(len(q), np.int64)

    def windows(self, tests: TestTexts, longest: np.ndarray):
        """(window, first, past the last) places in the array of every window that occurs."""
        reach = np.zeros(len(tests.left), np.int64)
        reach[tests.suffixes] = longest
        found = np.flatnonzero(reach[tests.window_place] >= tests.window_length)
        place, length = tests.window_place[found], tests.window_length[found]
        first, _, _ = self.search(tests.codes, place, length)
        past, _, _ = self.search(tests.codes, place, length, past=True)
        return found, first, past


def _matches(texts: list[np.ndarray], tests: TestTexts, old_spans: list, old_items: list, old_longest: list) -> list[tuple]:
    """(n_words, longest, spans, items) of each document of a shard, joined with what was found before.

    ``texts`` holds the word codes of each document.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int(sizes.sum()) + len(texts), np.int32)
    for s, words in zip(starts.tolist(), texts, strict=True):
        codes[s:s + len(words)] = words
    shard = Shard(codes, len(tests.vocabulary))
    longest, place = shard.longest(tests)
    found, first, past = shard.windows(tests, longest)

    change = np.zeros(len(codes) + 1, np.int64)
    many = past - first
    hits = shard.places[_bounds(first, many)]
    window = np.repeat(found, many)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + tests.window_length[window], -1)
    for s, spans in zip(starts.tolist(), old_spans, strict=True):
        for span in spans or ():
            change[s + span["start"]] += 1
            change[s + span["start"] + span["length"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list] = [[] for _ in texts]
    for a, b in edge.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans[d].append({"start": a - int(starts[d]), "length": b - a})

    def document(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, at, side="right") - 1

    items = [set(x or ()) for x in old_items]
    in_doc = np.unique(document(hits) * max(1, len(tests.window_place)) + window) if len(hits) else np.zeros(0, np.int64)
    for pair in in_doc.tolist():
        d, w = divmod(pair, len(tests.window_place))
        items[d].update(tests.window_items[tests.window_items_at[w]:tests.window_items_at[w + 1]].tolist())
    best = np.array([x or 0 for x in old_longest], np.int64)
    if len(place) and len(codes):
        # every place of a window's interval shares that window; the match itself may be longer at one of them
        np.maximum.at(best, document(place), longest)
        np.maximum.at(best, document(hits), tests.window_length[window])
    named = [sorted({tests.items[i] if isinstance(i, int) else i for i in x}) for x in items]
    return [(len(t), int(b), s, i) for t, b, s, i in zip(texts, best, spans, named, strict=True)]


def _pass(batches, tests: TestTexts, text: str, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Record batches with the columns of FOUND filled in or joined; ``text`` names the text column."""
    held, texts, size = [], [], 0

    def closed():
        old = [[x for b in held for x in b.column(c).to_pylist()] for c in ("spans", "items", "longest")]
        rows, at = _matches(texts, tests, *old), 0
        for b in held:
            some = rows[at:at + b.num_rows]
            at += b.num_rows
            columns = {f: b.column(f) for f in b.schema.names}
            columns |= {f: pa.array([r[k] for r in some], kind) for k, (f, kind) in enumerate(FOUND)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            some = [tests.coded(words_of(t)) for t in _texts(part.column(text))]
            held.append(part)
            texts += some
            size += sum(map(len, some))
            if size >= shard_words:
                yield from closed()
                held, texts, size = [], [], 0
    if held:
        yield from closed()


def _pieces(batches, window: int) -> Iterator[pa.RecordBatch]:
    """(item, text) rows -> (item, words joined by a blank, whole) rows of bounded length."""
    step = PIECE_WORDS
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), _texts(batch.column("text")), strict=True):
            words = words_of(text)
            cuts = range(0, max(1, len(words) - window + 1), step) if words else ()
            rows = [{"item": item, "words": b" ".join(words[c:c + step + window - 1]), "whole": len(words) < window} for c in cuts]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.string()), ("words", pa.binary()), ("whole", pa.bool_())]))


def _blocks(pieces: DataFrame, window: int, block_words: int) -> Iterator[TestTexts]:
    """Test texts in blocks of at most ``block_words`` words and one piece; the driver holds one at a time."""
    held, size, none = [], 0, True
    for row in pieces.toLocalIterator():
        words = bytes(row["words"]).split(b" ")
        held.append((row["item"], words, row["whole"]))
        size += len(words)
        if size >= block_words:
            yield TestTexts(held, window)
            held, size, none = [], 0, False
    if held or none:
        yield TestTexts(held, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``longest``, ``spans`` and ``items``; input columns of these names are replaced.

    A window is ``window`` consecutive words of a test text; a text of fewer words, but not none,
    is one window. ``spans`` (start, length in words, merged, in order) are the words inside any
    occurrence of a window, ``items`` the ids (as sorted strings) whose windows occur. ``longest``
    is the most words that the document is known to share verbatim with a test text: a match is
    counted for the document that holds it beside the test suffix in its shard's suffix array.

    A null or empty text has no words and no match. A null item id counts as ``""``; repeated items
    and repeated documents are each treated alike. Without test texts nothing is found; without
    documents there are no rows. Other columns stay as they are.
    """
    own = [n for n, _ in FOUND]
    names = [c for c in docs.columns if c not in own]
    kept = [f"c{i}" for i in range(len(names))]
    text = f"c{names.index(text_col)}"
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[n]}" for c, n in zip(kept, names, strict=True)), FOUND_DDL])
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    pieces = staged(items.mapInArrow(lambda it: _pieces(it, window), "item string, words binary, whole boolean"), "test-pieces")
    out = docs.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(kept, names, strict=True)],
                      *[F.lit(None).cast(kind).alias(n) for n, kind in (x.split(" ", 1) for x in FOUND_DDL.split(", ", 3))])
    context = docs.sparkSession.sparkContext
    before = None
    for tests in _blocks(pieces, window, block_words):
        if before is not None:
            out = staged(out, "contamination")
        before = context.broadcast(tests)
        out = out.mapInArrow(lambda it, b=before: _pass(it, b.value, text, shard_words), schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], *own)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that share no window with a test text."""
    found = find_contamination(docs, benchmark, window, **options)
    return found.filter(F.size("items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
