"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

The pairwise term of the machine, the sum over i < j of <v_i, v_j> x_i x_j, is scored in time
linear in the features by the sum-of-squares identity: half of (sum v_i x_i)^2 - sum (v_i x_i)^2,
summed over the factors. Fitting reads a bounded sample of labelled rows; scoring reads every
whole text.
"""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.labels import labelled_sample

HASHED, FACTORS = 1 << 13, 8
#: Bound of the labelled rows that a fit reads.
FIT_ROWS = 4000
#: At least so many passes over the rows, and at least so many steps.
EPOCHS, STEPS = 6, 600
BATCH, RATE, DECAY = 32, 0.1, 1e-4
STATISTICS = ["words", "chars", "word_length", "distinct", "repeated", "symbols", "capitals", "exclamations", "digits", "equal_lines", "size"]


def features(raw: bytes | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value) of the hashed words and the structure statistics of a whole text."""
    raw = raw or b""
    words = raw.split()
    n = max(1, len(words))
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64)
    bucket, count = np.unique(crc & np.uint64(HASHED - 1), return_counts=True)
    value = np.log1p(count)
    value /= math.sqrt(float(value @ value)) or 1.0 if len(value) else 1.0
    repeated = 0.0
    if len(words) > 2:
        grams = crc[:-2] * np.uint64(0x9E3779B97F4A7C15) + crc[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + crc[2:]
        repeated = 1 - len(np.unique(grams)) / len(grams)
    lines = raw.split(b"\n")
    size = max(1, len(raw))
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    stats = [
        math.log1p(len(words)), math.log1p(len(raw)), sum(map(len, words)) / n, len(np.unique(crc)) / n, repeated,
        without(b"#*$%&|<>") / n, without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, without(b"!") / n, without(b"0123456789") / size,
        1 - len(set(lines)) / len(lines), math.log1p(len(raw) if n_chars is None or n_chars != n_chars else max(0.0, n_chars)),
    ]
    return bucket.astype(np.uint16), value.astype(np.float32), np.array(stats, np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # hashed buckets, then statistics
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def row(self, bucket, value, stats):
        dense = np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)
        return np.concatenate((bucket.astype(np.int64), HASHED + np.arange(len(dense)))), np.concatenate((value, 0.3 * dense))

    def score(self, bucket, value, stats) -> float:
        at, x = self.row(bucket, value, stats)
        vx = self.factors[at] * x[:, None]
        total = vx.sum(axis=0)
        logit = self.bias + float(self.linear[at] @ x) + 0.5 * float(total @ total - np.einsum("ij,ij->", vx, vx))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 3) -> Machine:
    """Train by adaptive gradient steps; without rows every score is one half."""
    rng = np.random.default_rng(seed)
    width = HASHED + len(STATISTICS)
    stats = np.array([r[2] for r in rows], np.float32).reshape(len(rows), len(STATISTICS))
    scale = stats.std(axis=0) if len(rows) else np.ones(len(STATISTICS), np.float32)
    m = Machine(0.0, np.zeros(width, np.float32), rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32),
                stats.mean(axis=0) if len(rows) else np.zeros(len(STATISTICS), np.float32), np.where(scale > 1e-6, scale, 1))
    if not rows:
        m.factors[:] = 0
        return m
    data = [(*m.row(b, v, s), y) for b, v, s, y in rows]
    sum_b, sum_l, sum_f = 1.0, np.ones(width, np.float32), np.ones((width, FACTORS), np.float32)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(data)))):
        for batch in itertools.batched(rng.permutation(len(data)), BATCH):
            at = np.concatenate([data[i][0] for i in batch])
            x = np.concatenate([data[i][1] for i in batch])
            starts = np.cumsum([0, *(len(data[i][0]) for i in batch[:-1])])
            y = np.array([data[i][2] for i in batch], np.float32)
            vx = m.factors[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            pair = 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            logit = m.bias + np.add.reduceat(m.linear[at] * x, starts) + pair
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(batch)
            lens = np.diff([*starts, len(at)])
            gx = np.repeat(g, lens) * x
            grad_f = gx[:, None] * (np.repeat(total, lens, axis=0) - vx)
            order = np.argsort(at, kind="stable")
            which, first = np.unique(at[order], return_index=True)
            gl = np.add.reduceat(gx[order], first) + DECAY * m.linear[which]
            gf = np.add.reduceat(grad_f[order], first) + DECAY * m.factors[which]
            sum_l[which] += 100 * gl * gl
            sum_f[which] += 100 * gf * gf
            m.linear[which] -= 10 * RATE * gl / np.sqrt(sum_l[which])
            m.factors[which] -= 10 * RATE * gf / np.sqrt(sum_f[which])
            gb = float(g.sum())
            sum_b += 100 * gb * gb
            m.bias -= 10 * RATE * gb / math.sqrt(sum_b)
    return m


def _extracted(frames):
    for f in frames:
        got = [features(t, c) for t, c in zip(f["t"], f["c"], strict=True)]
        yield pd.DataFrame({"bucket": [b.tobytes() for b, _, _ in got], "value": [v.tobytes() for _, v, _ in got],
                            "stats": [s.tobytes() for _, _, s in got], "y": f["y"]})


def _size(docs: DataFrame, size_col: str | None):
    return F.col(size_col).cast("double") if size_col and size_col in docs.columns else F.lit(None).cast("double")


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", size_col: str | None = "n_chars",
                fit_rows: int = FIT_ROWS, folds: int = 4, held_out_fold: int = 2, id_col: str = "doc_id") -> Machine:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t"), _size(docs, size_col).alias("c")),
                             labels, label_col, fit_rows, folds, held_out_fold, id_col)
    got = sample.select("t", "c", "y", id_col).mapInPandas(
        _extracted, "bucket binary, value binary, stats binary, y int").toPandas()
    got = got.sort_values(["y", "bucket", "value"]).reset_index(drop=True)  # the order of the rows must not matter
    return fit([(np.frombuffer(b, np.uint16), np.frombuffer(v, np.float32), np.frombuffer(s, np.float32), int(y))
                for b, v, s, y in zip(got["bucket"], got["value"], got["stats"], got["y"], strict=True)])


def with_quality(docs: DataFrame, model: Machine, text_col: str = "text", size_col: str | None = "n_chars", out_col: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text.

    A null or empty text has no words and gets the score of its statistics; a null size counts as
    the text's length in bytes. Rows are scored one by one, so repeated rows score alike; an empty
    table gives no rows; an input column named ``out_col`` is replaced.
    """
    @F.arrow_udf("double")
    def score(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array((model.score(*features(t.as_py(), c)) for t, c in zip(texts, sizes.to_pylist(), strict=True)), pa.float64())

    return docs.withColumn(out_col, score(F.col(text_col).cast("binary"), _size(docs, size_col)))
