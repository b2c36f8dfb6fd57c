"""Token ids of whole texts with a tokenizer file, through a cache of its words.

Both tokenizer files cut a text into words before they merge, and never across the place
before a space that a non-space character follows. So the ids of a text are the ids of those
pieces one after another, and each distinct piece needs the tokenizer only once. Pieces of
plain letters, with punctuation after them, go to the tokenizer's merge model itself; all
others go through its whole encoder. The string of an added token, such as ``<|endoftext|>``,
gives that token's id, as in the library.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: A generation of cached pieces; the last full one is kept beside the one that fills.
CACHE_ENTRIES = 400_000
#: Texts that are encoded together; jobs that write ids set their Arrow batches to as many.
BATCH_TEXTS = 1024
#: A space that white space or the end of the text follows.
_NO_CUT = re.compile(r" (?=\s|$)")
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BIG_ENDIAN = sys.byteorder == "big"
MARKS = ".,!?;:*#$%&|"
_IN_CLASS = re.escape(MARKS)


def _byte_letters() -> str:
    """The printable stand-in of each byte in a byte-level vocabulary, in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class _Pieces(dict):
    """piece -> its ids as bytes; ``lead`` stands before the piece in the text."""

    def __init__(self, owner: TextEncoder, lead: str):
        super().__init__()
        self.owner, self.lead, self.before = owner, lead, {}
        self.lead_letter = owner.letters[ord(lead)] if lead else ""

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece) or self._ids(piece)
        if len(self) >= CACHE_ENTRIES:
            self.before = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        own = self.owner
        if piece.isalpha() and (piece.isascii() or max(piece) <= "ÿ"):
            return own.merged(self.lead_letter, piece)
        word = piece.rstrip(MARKS)
        if len(word) < len(piece) and word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
            return self[word] + own.bare[piece[len(word):]]
        first, *more = piece.split("\n")
        ends = [first, *more[:-1]]
        # a line end with no white space beside it is a word of its own
        if more and all(x and not x[-1].isspace() for x in ends) and all(x and not x[0].isspace() for x in more):
            return self[first] + b"".join(own.line + own.bare[x] for x in more)
        return own.encoded(self.lead + piece)


class TextEncoder:
    """``ids(text)``: what ``encode(text, add_special_tokens=False)`` gives, as little-endian bytes.

    ``width`` is the bytes of an id, 4 or 2; two hold ids below 65,536.
    """

    def __init__(self, path: str, width: int = 4):
        self.kind = {4: "I", 2: "H"}[width]
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: self._bytes([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.lowers = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.line = self.encoded("\n")
        self.bare = _Pieces(self, "")
        self.after_space = self.bare if self.lowers else _Pieces(self, " ")

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if BIG_ENDIAN:
            out.byteswap()
        return out.tobytes()

    def encoded(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, lead: str, word: str) -> bytes:
        """Ids of one word of letters by the merge model; ``lead`` is a space's stand-in or empty."""
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.merge(lead + word)])

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            # the encoder cuts at added tokens before all else and takes what is between on its own
            return b"".join(self.added.get(x) or self._between(x) for x in self.added_cut.split(text))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        pieces = text.split(" ")
        if len(pieces) > 1 and _NO_CUT.search(text):
            pieces = self._joined(pieces)
        return self.bare[pieces[0]] + b"".join(map(self.after_space.__getitem__, pieces[1:]))

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        """Undo the cuts before a space that white space or the end of the text follows."""
        out = [[pieces[0]]]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                out.append([p])
            else:
                out[-1].append(p)
        return [" ".join(group) for group in out]


    def batch(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """``ids(text) + end`` of each text, null being empty."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, f" ([{_SPACES}]|$)") if len(texts) else None
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        cut = pc.if_else(whole, "", texts)  # texts with such places are encoded on their own
        pieces = pc.split_pattern(cut, " ")
        starts = pieces.offsets.to_numpy()
        starts, stops = starts[:-1] - starts[0], starts[1:] - starts[0]
        pieces = pieces.flatten()
        forms = pieces.dictionary_encode()
        number = forms.indices.to_numpy().astype(np.int64)
        # the first piece of a text has no space before it
        bare = [self.bare[x] for x in pieces.take(pa.array(starts)).to_pylist()]
        for i, t in zip(alone.tolist(), texts.take(pa.array(alone)).to_pylist(), strict=True):
            bare[i] = self.ids(t)
        known = self._forms(forms.dictionary)
        number[starts] = len(known) + np.arange(len(texts))
        number = np.insert(number, stops, len(known) + len(texts))
        table = pa.concat_arrays([known, pa.array([*bare, end], pa.large_binary())])
        return _gathered(table, number, stops + np.arange(1, len(texts) + 1)).cast(pa.binary())

    def _forms(self, forms: pa.Array) -> pa.Array:
        """Ids of distinct pieces after a space; words of letters are looked up without the marks behind them."""
        word = pc.utf8_rtrim(forms, characters=MARKS)
        marked = pc.and_(pc.not_equal(pc.binary_length(word), pc.binary_length(forms)), pc.utf8_is_alpha(word))
        marked = pc.and_(marked, pc.equal(pc.utf8_length(word), pc.utf8_length(pc.replace_substring_regex(word, "[^\\x00-\\x{ff}]", ""))))
        marks = pc.replace_substring_regex(forms.filter(marked), f"^[^{_IN_CLASS}]+", "").dictionary_encode()
        words = pc.if_else(marked, word, forms).dictionary_encode()
        table = pa.array([*map(self.after_space.__getitem__, words.dictionary.to_pylist()),
                          *map(self.bare.__getitem__, marks.dictionary.to_pylist())], pa.large_binary())
        number = words.indices.to_numpy().astype(np.int64)
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        number = np.insert(number, at + 1, len(words.dictionary) + marks.indices.to_numpy().astype(np.int64))
        stops = np.arange(1, len(forms) + 1) + np.cumsum(marked.to_numpy(zero_copy_only=False))
        return _gathered(table, number, stops)


def _gathered(table: pa.Array, number: np.ndarray, stops: np.ndarray) -> pa.Array:
    """One value for each of ``stops``: the values of ``table`` at the numbers up to it, joined."""
    offsets = np.frombuffer(table.buffers()[1], np.int64, len(table) + 1)
    data = table.take(pa.array(number)).buffers()[2] or pa.py_buffer(b"")
    upto = np.concatenate([[0], np.cumsum(np.diff(offsets)[number])])[np.concatenate([[0], stops])]
    return pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(upto), data])


@functools.lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> TextEncoder:
    """One encoder for each tokenizer file and worker."""
    return TextEncoder(path, width)


def with_ids(docs: DataFrame, text_col: str, tokenizer: str, end_id: int | None = None, width: int = 4) -> DataFrame:
    """Add ``ids`` (binary, little-endian, ``width`` bytes each) of whole texts; null is the empty text.

    ``end_id`` is appended to each document.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        own = encoder(tokenizer, width)
        out = [own.batch(texts.slice(i, BATCH_TEXTS), end) for i in range(0, max(1, len(texts)), BATCH_TEXTS)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out)

    return docs.withColumn("ids", ids(F.coalesce(F.col(text_col), F.lit(""))))
