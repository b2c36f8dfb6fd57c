"""SimHash, components and line dedup against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from weftmark.llm import queries, simhash
from weftmark.llm.components import connected_components
from weftmark.llm.line_dedup import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_fingerprint(text, k=4):
    word, words = "", []
    for c in lowered(text or ""):
        if c in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius=4):
    """(id, fingerprint) rows -> the smallest id reachable, for each row."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    best = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            best[root(i)] = min(best.get(root(i), doc), doc)
    return [best.get(root(i)) for i in range(len(pairs))]


def test_covering_masks_meet_every_pair():
    rng = random.Random(1)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and {m.bit_count() for m in masks} <= {31, 32, 33, 34}
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not d & m for m in masks)


def test_fingerprint_of_long_and_odd_texts():
    rng = random.Random(2)
    odd = ["", " ", "A", "a B\tc", "x " * 9, "Ä É ß  Ñ\x0bq\x1cz", "\x1f \x85 a b c d", None]
    odd.append(" ".join(rng.choice(["ab", "Cd", "é", "xyz"]) for _ in range(400_000)))  # over one block
    odd.append("w" * 3_000_000)
    odd.append("a b " + "w" * 2_000_000 + " c d e " + "v" * 1_500_000 + " f")
    for t in odd:
        raw = None if t is None else t.encode()
        assert simhash.fingerprint(raw, 4) == (plain_fingerprint(t) if t is None or len(t) < 2_000_000 else simhash_once(raw))


def simhash_once(raw):
    words = raw.lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_op1_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    pairs = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(pairs, plain_components(pairs))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == want


def _fps(rng, centres, around):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_wide_buckets_take_the_ball_path(spark):
    fps = _fps(random.Random(3), 4, 40)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "simhash long")
    want = plain_components(list(enumerate(fps)))
    classes = {}
    for i, c in enumerate(want):
        classes.setdefault(c, set()).add(fps[i])
    for most in (simhash.MAX_BUCKET, 3):
        rows = connected_components(simhash.fingerprint_links(df, 4, most)).collect()
        found = {}
        for r in rows:
            found.setdefault(r.root, set()).add(r.node % 2**64)
        assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_bucket_runs_over_batches():
    import pyarrow as pa

    rng, rows = random.Random(4), []
    for key in range(6):
        rows += [(0, key, x) for x in _fps(rng, 1, 3 + 9 * (key % 2))]

    def batches(size):
        for i in range(0, len(rows), size):
            t, k, f = zip(*rows[i:i + size])
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(k, pa.int64()), pa.array([simhash._signed(x) for x in f], pa.int64())], names=["t", "key", "simhash"])

    def groups(size, most):
        links = [tuple(e.values()) for b in simhash._bucket_links(batches(size), 4, most) for e in b.to_pylist()]
        return sorted(a for a, b in links if b is None), len([1 for _, b in links if b is not None])

    for most in (100, 5):
        assert len({(tuple(w), n) for w, n in (groups(s, most) for s in (1, 2, 3, 7, 1000))}) == 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, None), (301, 302), (302, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[100 + i] for i in range(40)}) == 1
    assert got[301] == got[302] and 200 not in got and 300 not in got and len(set(got.values())) == 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z"),
            (9, "", "q"), (8, None, "r"), (None, "one two three four five six", "s"), (1, "nine eight seven six five four", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, simhash string")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[5], rows[6], rows[7]], key=str)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    ids = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert ids == {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (1, 1)}
    assert simhash.simhash_components(df.limit(0)).count() == 0


def plain_line_dedup(texts, least, chars=1):
    key = lambda line: lowered(line.strip(BLANK))
    found = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add(i)
    bad = {k for k, d in found.items() if len(d) >= least and len(k) >= chars}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_edge_cases(spark):
    texts = [" Foo\nbar\n", "foo \nBAZ", "FOO\n\n\nbar\nbar", None, "", "", "É\nfoo", "é\nx\n É", "a\x1cb\n\tfoo\r", "x " * 200_000 + "\nfoo", " Foo\nbar\n"]
    rows = [(i if i != 7 else None, t, "n") for i, t in enumerate(texts[:-1])] + [(0, texts[-1], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    for least, chars in ((2, 1), (4, 1), (2, 4), (100, 1)):
        got = line_dedup(df, min_documents=least, min_chars=chars).select("n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got)) == sorted(plain_line_dedup(texts, least, chars))
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup(docs).filter(F.col("n_dropped") > F.col("n_lines")).count() == 0
