"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word stands for itself and its character n-grams, each hashed to a row of an embedding
table, so an unseen misspelling shares most rows with the word it comes from. A text's
vector is the average over all its words' rows, where a word that occurs c times weighs
1 + ln c. Scoring needs only each word's sum of class differences, which is cached per word.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import staged
from weftmark.llm.labels import labelled_sample

BUCKETS, WIDTH = 1 << 16, 12
SHORTEST, LONGEST = 3, 5
#: Bound of the labelled rows that a fit reads.
FIT_ROWS = 4000
#: At least so many passes over the rows, and at least so many steps.
EPOCHS, STEPS = 8, 24_000
RATE, CAUTION = 3.0, 1e-4
#: Rows of the table are trained only for buckets whose document share differs between the classes
#: by so many standard errors of the log odds; all others stay zero.
SIGNIFICANT = 2.0
#: Zero rows in each average, so that the noise of a few words cannot decide.
PADDING = 800
CACHE_WORDS = 300_000
#: Buckets that are held at a time, and the longest word whose buckets are listed at once.
PART = 1 << 16
_EDGES = ".,;:!?\"'()[]{}#*$%&|<>"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in (text or "").lower().split()) if w]


def rows_of(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    whole = f"<{word}>"
    grams = [whole, *(whole[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(whole) - n + 1))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def rows_in_parts(word: str) -> Iterator[np.ndarray]:
    """The same buckets in parts of bounded size, for a long unbroken run of characters."""
    whole = f"<{word}>"
    yield np.array([zlib.crc32(whole.encode()) % BUCKETS])
    for n in range(SHORTEST, LONGEST + 1):
        last = len(whole) - n + 1
        for a in range(0, last, PART):
            yield np.array([zlib.crc32(whole[i:i + n].encode()) % BUCKETS for i in range(a, min(a + PART, last))])


@dataclass
class Subwords:
    """``gain``: a bucket's difference of the two logits; ``bias``: that of the classes."""

    gain: np.ndarray
    bias: float
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"gain": self.gain, "bias": self.bias, "cache": {}}

    def _word(self, word: str) -> tuple[float, int]:
        got = self.cache.get(word)
        if got is None:
            parts = [rows_of(word)] if len(word) <= PART else rows_in_parts(word)
            got = (0.0, 0)
            for at in parts:
                got = (got[0] + float(self.gain[at].sum()), got[1] + len(at))
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = got
        return got

    def score(self, text: str | None) -> float:
        total, n = 0.0, float(PADDING)
        for w, c in Counter(words_of(text)).items():
            gain, rows = self._word(w)
            weight = 1.0 if c == 1 else 1.0 + math.log(c)
            total += weight * gain
            n += weight * rows
        logit = self.bias + total / n
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit))))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of the padded average) of a whole text; each bucket once."""
    mass = np.zeros(BUCKETS)
    at, weight = [], []

    def fold():
        np.add.at(mass, np.array(at, np.int64), np.array(weight))
        at.clear()
        weight.clear()

    for w, c in Counter(words_of(text)).items():
        share = 1.0 + math.log(c)
        for rows in [rows_of(w)] if len(w) <= PART else rows_in_parts(w):
            at.extend(rows)
            weight.extend([share] * len(rows))
            if len(at) >= PART:
                fold()
    fold()
    which = np.flatnonzero(mass)
    return which.astype(np.uint16), (mass[which] / (mass.sum() + PADDING)).astype(np.float32)


def telling(among: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each bucket is trained; ``among[y, bucket]`` of ``size[y]`` documents hold it."""
    odds = np.log((among[1] + 0.5) / (size[1] + 1)) - np.log((among[0] + 0.5) / (size[0] + 1))
    return np.abs(odds) >= SIGNIFICANT * np.sqrt(1 / (among[1] + 0.5) + 1 / (among[0] + 0.5))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Subwords:
    """Train on (bucket, share, label) rows that hold only telling buckets.

    Without both labels every score is the share of label 1.
    """
    rng = np.random.default_rng(seed)
    share = (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)
    if len({y for _, _, y in rows}) < 2:
        return Subwords(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    head, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.array([math.log(1 - share), math.log(share)], np.float32)
    seen, seen_head = np.full(BUCKETS, CAUTION, np.float32), 1e-8
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(len(rows)):
            at, weight, y = rows[i]
            own = table[at]
            mean = weight @ own
            z = mean @ head + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y] -= 1
            back = head @ g
            g_head = np.outer(mean, g)
            seen[at] += (weight * weight) * float(back @ back)
            table[at] = own - (rate * weight / np.sqrt(seen[at]))[:, None] * back
            seen_head += float((g_head * g_head).sum())
            head -= rate / math.sqrt(seen_head) * g_head
            bias -= 0.05 * rate * g
    gain = np.where(seen > CAUTION, table @ (head[:, 1] - head[:, 0]), 0)  # a row never trained says nothing
    return Subwords(gain.astype(np.float32), float(bias[1] - bias[0]))


def _held(frames):
    """(label, bucket, documents) of a task's rows; the bucket after the last counts all of them."""
    among = np.zeros((2, BUCKETS + 1), np.int64)
    for f in frames:
        for t, y in zip(f["t"], f["y"], strict=True):
            among[int(y != 0), features(t)[0].astype(np.int64)] += 1
            among[int(y != 0), BUCKETS] += 1
    y, at = np.nonzero(among)
    yield pd.DataFrame({"y": y, "bucket": at, "n": among[y, at]})


def _told(frames, told: np.ndarray):
    for f in frames:
        rows = []
        for t, y in zip(f["t"], f["y"], strict=True):
            at, share = features(t)
            rows.append((at[told[at]].tobytes(), share[told[at]].tobytes(), int(y != 0)))
        yield pd.DataFrame(rows, columns=["bucket", "share", "y"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", fit_rows: int = FIT_ROWS,
                 folds: int = 5, held_out_fold: int = 0, id_col: str = "doc_id") -> Subwords:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold.

    Tasks hash the words. The driver gets a count for each bucket and class, and then each
    document's telling buckets.
    """
    sample = staged(labelled_sample(docs.select(F.col(id_col), F.col(text_col).alias("t")), labels, label_col, fit_rows, folds, held_out_fold, id_col)
                    .select("t", "y"), "labelled")
    counts = sample.mapInPandas(_held, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    among = np.zeros((2, BUCKETS + 1))
    among[counts["y"], counts["bucket"]] = counts["n"]
    told = telling(among[:, :BUCKETS], among[:, BUCKETS])
    got = sample.mapInPandas(lambda it: _told(it, told), "bucket binary, share binary, y int").toPandas()
    rows = sorted(zip(got["bucket"], got["share"], got["y"], strict=True), key=lambda r: (r[2], r[0], r[1]))  # the order must not matter
    return fit([(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(w, np.float32), int(y)) for b, w, y in rows])


def with_toxicity(docs: DataFrame, model: Subwords, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text.

    A null or empty text has no words and gets the score of the bias alone. Rows are scored one by
    one, so repeated rows score alike; an empty table gives no rows; an input column named
    ``out_col`` is replaced.
    """
    key = hashlib.sha256(model.gain.tobytes() + repr(model.bias).encode()).hexdigest()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        of = _here(key, model).score
        return pa.array((of(t.as_py()) for t in texts), pa.float64())  # one text at a time

    return docs.withColumn(out_col, score(F.col(text_col)))


_LAST: dict[str, Subwords] = {}


def _here(key: str, model: Subwords) -> Subwords:
    """This worker's copy of the model, so that its word cache outlives a task."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = model
    return _LAST[key]
