"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source shares are raised to an exponent between 0 (uniform) and 1 (as found), and normalised.
The exponent is bisected until the weights have the target entropy, or until no source is
repeated more often than allowed. Each job evaluates 31 exponents, five halvings at once, on
the table of sources; only their sums reach the driver.

The weights are realised by copies of whole documents. A source's last, partial pass takes a
prefix of a permutation: the source's documents are hashed to blocks, the blocks are put in
a seeded order, whole blocks are taken while the budget lasts, and the one block that
crosses it is cut in a seeded order of its documents. So a hot source is never in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.common import BLANK_CLASS, BLANKS, free_prefix, staged

BLOCK_ROWS = 2048
HALVINGS, JOBS = 5, 9


def word_count(text: Column) -> Column:
    """Words of a text, at least 1, so that each document costs something."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.size(F.split(trimmed, BLANK_CLASS + "+")).cast("long")


def _moments(sources: DataFrame, exponents: list[float]) -> list:
    """For each exponent a: z = sum p^a, e = sum p^a ln p, over all sources."""
    a = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a")
    p = sources.select("lp", a).withColumn("w", F.exp(F.col("a") * F.col("lp")))
    return p.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("lp")).alias("e")).orderBy("a").collect()


def _bracket(sources: DataFrame, holds) -> tuple[float, float]:
    """(lo, hi): ``holds`` is true up to lo and false from hi; equal ends if it never changes."""
    ends = _moments(sources, [0.0, 1.0])
    if not holds(ends[0]):
        return 0.0, 0.0
    if holds(ends[1]):
        return 1.0, 1.0
    lo, hi, k = 0.0, 1.0, 1 << HALVINGS
    for _ in range(JOBS):
        rows = _moments(sources, [lo + (hi - lo) * i / k for i in range(1, k)])
        fails = [r.a for r in rows if not holds(r)]
        hi = min(fails, default=hi)
        lo = max((r.a for r in rows if r.a < hi), default=lo)
    return lo, hi


def source_weights(counts: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None,
                   budget_tokens: int | None = None, entropy_gain: float | None = None, budget_share: float | None = None) -> DataFrame:
    """Staged (key, tokens, rows) of each source -> the same with weight, repeats, full, rest.

    ``budget_tokens`` None sets the budget so that the largest source is used exactly once and
    all others at least once; ``budget_share`` sets it to that share of all tokens.
    ``entropy_share``: the weights have at least this share of the largest possible entropy.
    ``entropy_gain``: they close that part of the gap between the entropy as found and the largest
    possible. ``max_repeats``: no source is repeated more often. Where both are
    given, the limit on repeats comes first; one that no exponent can meet leaves the shares
    as found. ``full`` whole passes and ``rest`` tokens of one more realise the weight.
    """
    total = counts.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.n:
        return counts.withColumns({"weight": F.lit(0.0), "repeats": F.lit(0.0), "full": F.lit(0).cast("long"), "rest": F.lit(0).cast("long")})
    if budget_share is not None:
        budget_tokens = round(budget_share * total.t)
    sources = counts.withColumn("lp", F.log(F.col("tokens") / F.lit(float(total.t))))
    ends = sources.agg(F.min("lp").alias("lo"), F.max("lp").alias("hi")).first()

    def most(r) -> float:
        """Repeats of the smallest source at exponent r.a."""
        if budget_tokens is None:
            return math.exp((r.a - 1) * (ends.lo - ends.hi))
        return budget_tokens / total.t * math.exp((r.a - 1) * ends.lo) / r.z

    def entropy(r) -> float:
        return math.log(r.z) - r.a * r.e / r.z

    a, targets = 0.0, []
    if entropy_share is not None:
        targets.append(entropy_share * math.log(total.n))
    if entropy_gain is not None:
        found = entropy(_moments(sources, [1.0])[0])
        targets.append(found + entropy_gain * (math.log(total.n) - found))
    if targets:
        a = _bracket(sources, lambda r: entropy(r) >= max(targets))[0]
    if max_repeats is not None:
        a = max(a, _bracket(sources, lambda r: most(r) > max_repeats)[1])
    z = _moments(sources, [a])[0].z
    weight = F.exp(F.lit(a) * F.col("lp")) / F.lit(z)
    repeats = F.exp(F.lit(a - 1) * (F.col("lp") - F.lit(ends.hi))) if budget_tokens is None else weight * F.lit(float(budget_tokens)) / F.col("tokens")
    out = sources.withColumns({"weight": weight, "repeats": repeats})
    quota = F.round(F.col("repeats") * F.col("tokens")).cast("long")
    return out.withColumns({"full": F.floor(quota / F.col("tokens")), "quota": quota}).withColumn(
        "rest", F.col("quota") - F.col("full") * F.col("tokens")).drop("quota", "lp")


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                entropy_share: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None,
                entropy_gain: float | None = None, budget_share: float | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repeat or leave out documents so that each source meets its weight; see ``source_weights``.

    Adds ``mix_epoch`` (pass, from 0), ``mix_block`` and ``mix_order`` (long; sorting by the three
    gives the seeded block permutation of each pass), ``mix_weight`` and ``mix_repeats`` (of the
    source). A null source is a source of its own. Tokens are words, 1 at least, also for null
    and empty texts. Equal rows (id and text) are taken or left together, so a source's tokens
    miss its quota by less than one document and its copies. An empty table gives no rows; added
    columns replace input columns of their names.
    """
    names = ["mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_repeats"]
    p = free_prefix(docs)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    row = [F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]  # hashes pass over nulls
    hashed, placed = F.xxhash64(F.lit(seed), *row), F.xxhash64(F.lit(seed), F.lit("order"), *row)
    rows = staged(docs.select(key.alias("key"), hashed.alias("h"), placed.alias("o"), word_count(F.col(text_col)).alias("tokens")), "mix-rows")
    counts = staged(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    sources = staged(source_weights(counts, entropy_share, max_repeats, budget_tokens, entropy_gain, budget_share)
                     .withColumn("blocks", F.ceil(F.col("rows") / block_rows)), "mix-weights")

    block = lambda h: F.pmod(F.col(h), F.col("blocks"))
    order = lambda k, b: F.xxhash64(F.lit(seed), F.lit("block"), F.col(k), b)
    located = rows.join(sources.select("key", "blocks", "rest"), "key").withColumn("b", order("key", block("h")))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = located.groupBy("key", "b", "rest").agg(F.sum("tokens").alias("t"))
    blocks = blocks.withColumn("upto", F.sum("t").over(upto("key").orderBy("b")))
    edge = staged(blocks.filter("upto > rest and upto - t <= rest").select("key", "b", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")), "mix-edges")
    inside = located.join(edge, ["key", "b"]).groupBy("key", "b", "o", "room").agg(F.sum("tokens").alias("t"))
    inside = inside.withColumn("upto", F.sum("t").over(upto("key", "b").orderBy("o"))).filter("upto <= room")
    cut = inside.groupBy("key").agg(F.max("o").alias("cut"))
    plan = staged(sources.join(edge.select("key", F.col("b").alias("edge")), "key", "left").join(cut, "key", "left").select(
        F.col("key").alias(f"{p}key"), F.col("blocks").alias(f"{p}blocks"), F.col("edge").alias(f"{p}edge"), F.col("cut").alias(f"{p}cut"),
        F.col("full").alias(f"{p}full"), F.col("weight").alias("mix_weight"), F.col("repeats").alias("mix_repeats")), "mix-plan")

    out = docs.drop(*names).withColumns({f"{p}key": key, f"{p}h": hashed, "mix_order": placed}).join(plan, f"{p}key")
    out = out.withColumn("mix_block", order(f"{p}key", F.pmod(f"{p}h", f"{p}blocks")))
    more = (F.col("mix_block") < F.col(f"{p}edge")) | ((F.col("mix_block") == F.col(f"{p}edge")) & (F.col("mix_order") <= F.col(f"{p}cut")))
    copies = (F.col(f"{p}full") + F.coalesce(more, F.lit(False)).cast("long")).cast("int")
    out = out.withColumn(f"{p}n", copies).filter(F.col(f"{p}n") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col(f"{p}n") - 1)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *names)
