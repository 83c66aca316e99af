"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list is each distinct x vector once; its sums S and
number n are exact, so a centred row (n x - S) / n has no rounding but that of one division. Centred rows are numbered
and become a ``BlockMatrix``; its transpose times itself is the scatter matrix, the only thing besides sums that
comes to the driver (``MOST_DIMENSIONS`` squared numbers at most). ``eigh`` there gives the components, and a second product with the
whitening matrix projects all rows.

Products of one block row by one block column are split along the rows (``numMidDimSplits``), so that a task holds ``TASK_BLOCKS``
blocks of ``BLOCK_CELLS`` numbers; partial products are summed before they are shuffled. Spark's planning of a product keeps
the coordinates of all blocks on the driver, two integers for each half million numbers.

A table is fitted by its distinct vectors and every row is projected by itself, so copies of one vector meet only in
partial aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import indexed

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, or as many as there are dimensions.
COMPONENTS = 16
#: Numbers in a block (4 MB), columns in a block, blocks that a task works on.
BLOCK_CELLS, BLOCK_COLUMNS, TASK_BLOCKS = 1 << 19, 1024, 8
#: Bound of the scatter matrix on the driver: 134 MB.
MOST_DIMENSIONS = 4096
#: Components whose eigenvalue is at most this share of the largest are rounding, not a direction of the data.
RANK = 1e-12

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column) -> Column:
    """The vector as whole numbers; null where it is null or has a null or non-finite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | F.abs(c.cast("double")).isin(float("inf")))
    return F.when(~odd, F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + SHIFT))


def _numbers(values: list[int]) -> Column:
    """A constant array, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """The (index, array) ``rows`` as a matrix of n rows and d columns."""
    high = max(1, BLOCK_CELLS // d)
    tasks = math.ceil(n / high / TASK_BLOCKS)
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(high, min(d, BLOCK_COLUMNS))


def gram(m: BlockMatrix) -> np.ndarray:
    """The transpose of ``m`` times ``m``, on the driver: a matrix of its columns."""
    splits = max(1, math.ceil(m.numRowBlocks / TASK_BLOCKS))
    java = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def local_matrix(spark, values: np.ndarray, high: int) -> BlockMatrix:
    """A small matrix in blocks of ``high`` rows and all columns."""
    blocks = [((i, 0), Matrices.dense(len(b), b.shape[1], b.flatten("F"))) for i, b in enumerate(values[a : a + high] for a in range(0, len(values), high))]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), high, values.shape[1])


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance by falling size, the share of each in their sum, and the whitening matrix, a column a component."""
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = np.trace(scatter) / n
    held = values > RANK * max(values[0], 0)
    scale = np.where(held, 1 / np.sqrt(np.where(held, values, 1)), 0)
    return values[:most], np.where(held, values / (trace or 1), 0)[:most], (vectors * scale)[:, :most]


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each row whose vector is whole, on each component.

    Rows whose vector is null or has a null or non-finite entry are left out; a null or repeated key is kept, each row
    by itself; repeated vectors count once in the fit and are all projected; other columns are not read. Without any row, or with
    vectors of no entries, the result is empty. Vectors of several lengths are a ValueError, as are more than ``MOST_DIMENSIONS`` entries. A
    component without variance (``RANK``; all of them if there is one distinct vector) has a null ``whitened``, explains 0 and is not part of
    ``identity_error``, which is null where no component is left. Deviations beyond 64 bits are an error. The order of equal eigenvalues
    and the signs are those of ``eigh``, the same for all rows.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[key].dataType.simpleString()
    rows = indexed(embeddings.select(F.col(key).alias("key"), whole(F.col(vector)).alias("x")).where("x is not null"), "vectors")
    seen = rows.agg(F.count("*").alias("rows"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not seen.rows or not seen.high:
        return spark.createDataFrame([], f"`{key}` {kind}, {RESULT}")
    d = seen.high
    if seen.low != d or d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {seen.low} to {d} entries; all have to have as many, {MOST_DIMENSIONS} at most")
    fit = indexed(rows.select("x").distinct(), "distinct-vectors")
    sums = {r.pos: (r.n, r.s) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("col").alias("s")).collect()}
    n, s = sums[0][0], _numbers([sums[i][1] for i in range(d)])
    off = F.zip_with("x", s, lambda x, t: F.lit(n) * x - t)
    centred = F.transform(off, lambda c: c.cast("double") / F.lit(float(n)))

    fitted = block_matrix(fit.select("index", centred.alias("centred")), n, d)
    values, explained, weights = components(gram(fitted), n, min(most, d))
    held = [i for i in range(len(values)) if explained[i] > 0]
    by = local_matrix(spark, weights, fitted.colsPerBlock)
    error = None
    if held:
        spread = gram(fitted.multiply(by)) / n
        error = float(np.abs(spread - np.eye(len(values)))[np.ix_(held, held)].max())

    projected = block_matrix(rows.select("index", centred.alias("centred")), seen.rows, d).multiply(by).toIndexedRowMatrix()
    places = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("at"))
    far = F.aggregate(off, F.lit(0).cast("long"), lambda a, c: a + c * c)
    told = rows.select("index", "key", far.alias("deviation")).join(places, "index")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    each = told.select("key", "deviation", shares.alias("shares"), F.posexplode("at"))
    share = F.element_at("shares", F.col("pos") + 1)
    return each.select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(share > 0, F.col("col")).alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
