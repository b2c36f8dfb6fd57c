"""Embedding whitening on MLlib's distributed BlockMatrix.

Centred rows get consecutive indices and are laid out in blocks of rows. The transpose times the
blocks is the scatter matrix, whose size is that of one vector squared; its eigenvectors are found
on the driver. The blocks times the whitening matrix project every row. Vectors stay in the JVM
throughout.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.common import staged

#: Rows of a block; the driver lists the blocks, so there are at most MOST_BLOCKS of them.
BLOCK_ROWS, MOST_BLOCKS = 4096, 1 << 16
#: Row blocks that one task of the scatter multiplies.
BLOCKS_A_TASK = 8
#: The d x d scatter matrix is a local matrix.
MOST_DIMENSIONS = 8192
#: Rounded entries lie below this, so that their exact products fit a decimal.
LARGEST = 1 << 40
EXACT = "decimal(38,0)"


def _usable(v: Column) -> Column:
    """No null, non-finite or huge entry."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(float(LARGEST // 2048))))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _indexed(rows: DataFrame) -> DataFrame:
    """Staged ``rows`` with ``place`` -> the same with ``index``, consecutive from 0."""
    part = F.shiftrightunsigned("place", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row for each task that wrote the rows
    first = counts.withColumn("first", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("part", F.coalesce("first", F.lit(0)).alias("first"))
    return rows.withColumn("part", part).join(F.broadcast(first), "part").withColumn(
        "index", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "first", "place")


def _row_matrix(rows: DataFrame, n: int, d: int) -> IndexedRowMatrix:
    """Rows (index, array of double) as an IndexedRowMatrix."""
    index, values = rows.columns
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector"))), n, d)


def _rows(matrix: BlockMatrix) -> DataFrame:
    """A BlockMatrix as rows (index, y array of double)."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(found).select("index", vector_to_array("vector").alias("y"))


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix; row blocks are dealt over tasks along the summed dimension."""
    tasks = max(1, -(-math.ceil(blocks.numRows() / blocks.rowsPerBlock) // BLOCKS_A_TASK))
    turned = blocks.transpose()
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, tasks)
    out = BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns); the greatest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def whiten(vectors: DataFrame, vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000, components: int = 8,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``vectors`` that have a usable vector, without ``vector_col``, and the columns

    ``n`` (rows of the fit list, which is all of them), ``deviation`` (decimal, the exact sum over
    dimensions of (n*x - S)^2), ``whitened`` and ``explained`` (arrays, a value for each component)
    and ``identity_error``. Here x is floor(scale * c) + shift and S its sum over all rows; input
    columns of these names are replaced. All other columns and repeated rows stay.

    A vector that is null or empty, or holds a null, non-finite or huge entry (2^29 or more), takes no
    part; nor does one whose length differs from the commonest (the greater of two as common).
    A component without variance (relative to the trace, 1e-12 or less) has null in ``whitened``
    and is left out of ``identity_error``; without any variance ``explained`` is null too. No
    usable vector gives no rows.
    """
    own = ["n", "deviation", "whitened", "explained", "identity_error"]
    names = [c for c in vectors.columns if c not in (*own, vector_col)]
    kept = [f"c{i}" for i in range(len(names))]
    spark = vectors.sparkSession
    v = F.col("v")
    x = F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(shift))
    rows = vectors.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept, strict=True)], F.col(f"`{vector_col}`").alias("v"))
    rows = staged(rows.filter(_usable(v)).select(*kept, x.alias("x"), F.monotonically_increasing_id().alias("place")), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    out_schema = [*[f"{k} {vectors.schema[c].dataType.simpleString()}" for c, k in zip(names, kept, strict=True)],
                  "n long", f"deviation {EXACT}", "whitened array<double>", "explained array<double>", "identity_error double"]
    if not lengths:
        return spark.createDataFrame([], ", ".join(out_schema)).toDF(*names, *own)
    d, n = lengths[0]["d"], lengths[0]["count"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MOST_DIMENSIONS} are whitened")
    if rows.filter(F.size("x") != d).head(1):
        rows = staged(rows.filter(F.size("x") == d).drop("place").withColumn("place", F.monotonically_increasing_id()), "whitening-rows")
    per = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in per.orderBy("i").collect()]  # a row for each dimension

    # n*x - S, exactly
    totals = F.array(*[F.lit(str(s)).cast(EXACT) for s in sums])
    lifted = F.zip_with("x", totals, lambda a, s: (a.cast("decimal(15,0)") * F.lit(str(n)).cast("decimal(20,0)")).cast(EXACT) - s)
    rows = _indexed(rows).withColumn("from_mean", lifted)
    square = F.aggregate("from_mean", F.lit(0).cast(EXACT), lambda acc, a: (acc + (a * a).cast(EXACT)).cast(EXACT))
    rows = staged(rows.select(*kept, "index", square.alias("deviation"),
                              F.transform("from_mean", lambda a: a.cast("double") / F.lit(float(n))).alias("centred")), "whitening-centred")

    per_block = max(block_rows, -(-n // MOST_BLOCKS))
    blocks = _row_matrix(rows.select("index", "centred"), n, d).toBlockMatrix(per_block, d)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    covariance = _scatter(blocks) / n
    values, axes = principal(covariance, min(components, d))
    total = float(np.trace(covariance))
    live = values > max(total, 0.0) * 1e-12
    weights = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    k = weights.shape[1]
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, weights.T.reshape(-1).tolist()))], 1), d, k)
    projected = staged(_rows(blocks.multiply(whitening)), "whitened")
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)

    alive = np.flatnonzero(live).tolist()
    pairs = [(a, b) for a in alive for b in alive if a <= b]
    error = None
    if pairs:
        got = projected.agg(*[F.covar_pop(F.col("y")[a], F.col("y")[b]).alias(f"v{a}_{b}") for a, b in pairs]).head()
        error = max(abs(got[f"v{a}_{b}"] - (a == b)) for a, b in pairs)
    share = F.array(*[F.lit(float(e / total) if total > 0 else None).cast("double") for e in values])
    mask = F.array(*[F.lit(bool(x)) for x in live])
    done = rows.join(projected, "index").select(
        *kept, F.lit(n).cast("long").alias("n"), "deviation", F.zip_with("y", mask, lambda y, ok: F.when(ok, y)).alias("whitened"),
        share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    return done.toDF(*names, *own)
