"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, folds: int, held_out_fold: int,
                    id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` documents with a known label (column ``y``) outside the held-out fold.

    The labels are chosen by the hash of their id and number at most ``rows``, so they are
    broadcast and only labelled documents are shuffled. Of repeated rows of an id the one with
    the least hash stays for each of its labels.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out_fold))
    some = known.select(id_col, F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col, "y").limit(rows)
    every = docs.join(F.broadcast(some), id_col)
    return every.groupBy(id_col, "y").agg(F.min_by(F.struct(*every.columns), F.xxhash64(*docs.columns)).alias("d")).select("d.*")
