"""Periodic runs of words: Baier's grouping gives Lyndon arrays, whose roots extend into runs.

Phase one of Baier's suffix sorter groups the places of a text by their longest Lyndon factor
and keeps the groups in order. A place's factor length is its entry of the Lyndon array, and two
places share a group exactly when their factors are equal. Done under an order of the words and
under its reverse, one of the two Lyndon arrays holds a root of every run. A run of three periods
or more holds at least two whole roots side by side, and these are in one group. So a chain of
equal groups, one period apart, is a candidate; longest common extensions to both sides turn it
into the run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("runs", pa.list_(RUN)), ("best", RUN), ("collapsed", pa.string())])
FOUND_DDL = ("struct<runs:array<struct<start:long,length:long,period:long>>,"
             "best:struct<start:long,length:long,period:long>,collapsed:string>")


def lyndon_groups(codes: list[int], n_codes: int) -> tuple[list[int], list[int]]:
    """(group of each place, factor length of each group) for ``codes`` below ``n_codes``, all used.

    Groups begin as the places of one code and are taken from the greatest down. A taken group's
    places leave the text; each place left of them, if now followed by k of them in a row, has its
    factor longer by k of the group's, and moves to a new group just above its old one.
    """
    n = len(codes)
    # group n_codes is an empty one above all others
    places = [[] for _ in range(n_codes + 1)]
    for i, c in enumerate(codes):
        places[c].append(i)
    group, size, live = list(codes), [1] * n_codes + [0], [len(p) for p in places]
    below, above = list(range(-1, n_codes)), list(range(1, n_codes + 2))
    # neighbours that are still in the text; place -1 shares the last slot, which nobody reads
    left, right = list(range(-1, n)), list(range(1, n + 2))
    g = n_codes - 1

    def moved(some, old, more):
        new = len(size)
        live[old] -= len(some)
        live.append(len(some))
        for p in some:
            group[p] = new
        places.append(some)
        size.append(size[old] + more)
        up = above[old]
        above.append(up)
        above[old] = below[up] = new
        below.append(old)

    while g >= 0:
        own, u = places[g], size[g]
        if live[g] == 1:
            i = own[0] if len(own) == 1 else next(p for p in own if group[p] == g)
            p, r = left[i], right[i]
            right[p], left[r] = r, p
            if p >= 0:
                q = group[p]
                if live[q] == 1:
                    size[q] += u
                else:
                    moved([p], q, u)
        else:
            if live[g] != len(own):
                own = [i for i in own if group[i] == g]
            parts, last, k = {}, -1, 0
            for i in own:
                p, r = left[i], right[i]
                right[p], left[r] = r, p
                if p == last:
                    k += 1
                else:
                    if last >= 0:
                        parts.setdefault((k, group[last]), []).append(last)
                    last, k = p, 1
            if last >= 0:
                parts.setdefault((k, group[last]), []).append(last)
            for k, q in sorted(parts, reverse=True) if len(parts) > 1 else parts:
                some = parts[k, q]
                if len(some) == live[q]:
                    size[q] += k * u
                else:
                    moved(some, q, k * u)
        g = below[g]
    return group, size


def _extended(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """Words that agree from places a and b on, to the right (step 1) or left (step -1)."""
    if step > 0:
        x, y = codes[a:a + len(codes) - b], codes[b:]
    else:
        x, y = codes[a::-1] if a >= 0 else codes[:0], codes[b:b - a - 1 if b > a else None:-1]
    block, done = 32, 0
    while done < len(x):
        differ = np.flatnonzero(x[done:done + block] != y[done:done + block])
        if len(differ):
            return done + int(differ[0])
        done += block
        block *= 4
    return len(x)


def runs_of(words: list[str], min_words: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``min_words`` words and ``min_repeats`` periods, by start and period."""
    if min_repeats < 3:
        raise ValueError("runs of under three periods need not hold two whole roots")
    n = len(words)
    if n < max(min_words, min_repeats):
        return []
    names: dict[str, int] = {}
    codes = [names.setdefault(w, len(names)) for w in words]
    at, top = np.array(codes, np.int32), len(names) - 1
    found, here = set(), np.arange(n)
    for order in (codes, [top - c for c in codes]):
        group, size = lyndon_groups(order, top + 1)
        of, period = np.array(group), np.array(size)[group]
        following = here + period
        twin = np.flatnonzero(following < n)
        twin = twin[of[following[twin]] == of[twin]]
        for i in twin.tolist():
            p, g = int(period[i]), group[i]
            if i >= p and group[i - p] == g:
                continue  # not the first of its chain
            end = i + 2 * p
            while end < n and group[end] == g:
                end += p
            end = min(end, n)
            if end - i + 2 * (p - 1) < max(min_words, min_repeats * p):
                continue
            stop = end + _extended(at, end - p, end, 1)
            start = i - _extended(at, i - 1, i - 1 + p, -1)
            if stop - start >= max(min_words, min_repeats * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, then smallest start, then period (exact)."""
    best = None
    for r in runs:  # by start and period, so the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    if not runs:
        return " ".join(words)
    kept, done = [], 0
    for first, stop in sorted((s + p, s + n) for s, n, p in runs):
        if first > done:
            kept += words[done:first]
        done = max(done, stop)
    return " ".join(kept + words[done:])


def _rows(runs: list) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs]


def periodic_runs(text: Column, min_words: int = 24, min_repeats: int = 3) -> Column:
    """Struct of ``runs``, ``best`` (null without runs) and ``collapsed`` for the words of whole texts.

    Words are separated by ASCII white space. ``collapsed`` holds, joined by one space, the words
    outside all repeats: a run's first period stays. A null or empty text has no runs and an empty
    ``collapsed``. Every row is worked out on its own, so repeated rows get equal results. A text
    of n words takes some 250 bytes a word in its task.
    """

    @F.arrow_udf(FOUND_DDL)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = WORD.findall(t or "")
            runs = runs_of(words, min_words, min_repeats)
            best = _best(runs)
            out.append({"runs": _rows(runs), "best": _rows([best])[0] if best else None, "collapsed": _collapsed(words, runs)})
        return pa.array(out, FOUND)

    return found(text)


def collapse_runs(docs: DataFrame, text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """``docs`` with ``runs``, ``best_run`` and ``collapsed``; input columns of these names are replaced.

    All other columns and all rows stay as they are; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("runs", "best_run", "collapsed")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("t"))
    done = plain.withColumn("f", periodic_runs(F.col("t"), min_words, min_repeats))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
                       F.col("f.runs").alias("runs"), F.col("f.best").alias("best_run"), F.col("f.collapsed").alias("collapsed"))
