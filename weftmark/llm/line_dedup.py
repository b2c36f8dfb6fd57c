"""Line deduplication with DataFrame functions only.

Lines are exploded once as keys per document, counted over documents with map-side partial
sums, and the listed keys are joined back to give the line positions that each document
loses. Only keys and positions are shuffled for that; the texts move once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import BLANKS, ascii_lower, free_prefix, staged


def _digest(key: Column) -> Column:
    """96 bits of a line's key, as text: arrays of text are made distinct by hashing."""
    return F.substring(F.md5(key), 1, 24)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10,
               min_chars: int = 1) -> DataFrame:
    """Drop every line whose key is found in at least ``min_documents`` documents.

    A key is the line without ASCII white space at its ends and with A-Z lowered; keys shorter
    than ``min_chars`` code points always stay. Rows of one id are one document; each row with a
    null id is one of its own. Null and empty texts are one empty line, and come back as the empty text. All
    columns are kept, ``text_col`` is replaced, and ``n_lines`` and ``n_dropped`` (long) are
    added (or replace columns of these names). An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    # equal (id, text) rows lose the same lines, so a digest of both serves as the row's key
    row = [F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]  # hashes pass over nulls
    rid = [F.xxhash64(*row).alias("r"), F.xxhash64(F.lit(1), *row).alias("s")]
    keyed = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x, i: F.struct(
        i.cast("int").alias("at"), F.btrim(x, F.lit(BLANKS)).alias("k")))
    keyed = F.transform(F.filter(keyed, lambda x: F.char_length(x["k"]) >= min_chars), lambda x: F.struct(
        x["at"].alias("at"), _digest(x["k"]).alias("k")))
    found = staged(docs.select(*rid, F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("row"),
                               keyed.alias("ls")), "line-keys")
    # no key is in more documents than rows, so only keys of enough rows are counted by document
    per_row = found.select(F.explode(F.array_distinct(F.col("ls.k"))).alias("k"))
    often = staged(per_row.groupBy("k").count().filter(F.col("count") >= min_documents).select("k"), "often")
    at = found.select("r", "s", "id", "row", F.explode("ls").alias("l")).select("r", "s", "id", "row", F.col("l.at"), F.col("l.k"))
    hits = staged(at.join(often, "k", "left_semi"), "hits")
    listed = staged(hits.select("k", "id", "row").distinct().groupBy("k").count().filter(F.col("count") >= min_documents).select("k"), "lines")
    lost = staged(hits.join(listed, "k", "left_semi").groupBy("r", "s").agg(F.collect_set("at").alias("lost")), "lost")
    r, s, at = (free_prefix(docs) + x for x in ("r", "s", "lost"))
    out = docs.withColumns({r: rid[0], s: rid[1]}).join(lost.select(F.col("r").alias(r), F.col("s").alias(s), F.col("lost").alias(at)), [r, s], "left")
    gone = F.coalesce(at, F.array().cast("array<int>"))
    # the split lines are a lambda variable, so that they are made once for each text
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.element_at(ls, i + 1)), "\n"))[0]
    return out.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.size(gone).cast("long"),
        text_col: F.when(F.size(gone) == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept),
    }).drop(r, s, at)
