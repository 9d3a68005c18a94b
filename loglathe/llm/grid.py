"""Integer vectors, and blocks of queries met with blocks of rows.

A stated set of query rows is compared with all rows: queries are dealt into
blocks, rows into others, and each pair of blocks is one group of bounded size,
in which a search prunes as it can.  What blocks find is merged by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Queries of a block, and rows of one at most and (where there are enough) at least.
QUERIES, ROWS, FEWEST = 1024, 32768, 4096
#: Squared length of an integer vector up to which all scores fit in 64 bits.
LONGEST = float(1 << 62)


def integers(df: DataFrame, scale: int, *columns: Column | str) -> DataFrame:
    """row, vec_id, vector (array of int) and the columns, stored; ``row`` is a number of its own.

    A component x becomes floor(scale * x), x as double.  Vectors that are null
    or hold null or non-finite components take no part, nor do those whose
    scaled length is 2**31 or more, whose scores need not fit in 64 bits.
    """
    base = df.select(*columns, F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = base.where(F.coalesce(finite, F.lit(False)))
    good = good.where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1)) < LONGEST)
    scaled = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return C.stored(good.select(*columns, "vec_id", F.monotonically_increasing_id().alias("row"), scaled.alias("vector")), "integers")


def pairs(queries: DataFrame, rows: DataFrame, weight: int = 1, together: Column | str = "row") -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cell``, for groups that hold a block of each; a query has ``weight`` rows at most.

    Where blocks of the largest size give fewer groups than there are tasks,
    blocks of rows are smaller.  Each row goes to every block of queries, each
    query to every block of rows; rows of equal ``together`` share a block.
    """
    m, n = queries.count() // weight, rows.count()
    across = max(1, math.ceil(m / QUERIES))
    down = max(math.ceil(n / ROWS), min(math.ceil(n / FEWEST), math.ceil(C.tasks(rows.sparkSession) / across)), 1)

    def dealt(df: DataFrame, key: Column | str, own: int, others: int, place) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own))
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", place(block, F.col("other"))).drop("other")

    return dealt(queries, "row", across, down, lambda q, r: q * down + r), dealt(rows, together, down, across, lambda r, q: q * down + r)


def matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers."""
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return np.asarray(flat, dtype=np.int64).reshape(len(vectors), dim)


def by_length(table: pa.Table) -> dict[int, pa.Table]:
    """Tables of the vectors of each length; where one side of a group is empty, columns can be missing."""
    if not table.num_rows or "vector" not in table.column_names:
        return {}
    lengths = np.asarray(table.column("vector").combine_chunks().value_lengths())
    return {int(d): table.take(pa.array(np.flatnonzero(lengths == d))) for d in np.unique(lengths)}


def ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """vec_id (null: the largest number, after all others in ties) and row."""
    return np.asarray(table.column("vec_id").combine_chunks().fill_null(np.iinfo(np.int64).max), dtype=np.int64), np.asarray(table.column("row").combine_chunks(), dtype=np.int64)


def identifiers(table: pa.Table, found: np.ndarray, place: np.ndarray) -> pa.Array:
    """The identifiers of rows that were found in the table, null where they are null there."""
    if not len(found):
        return pa.array(found, pa.int64())
    none = np.asarray(table.filter(table.column("vec_id").is_null()).column("row"), dtype=np.int64)
    return pa.array(found, pa.int64(), mask=np.isin(place, none))


def best(score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller identifiers, then rows."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((row[some], ident[some], -score[some]))[:k]]
    return np.lexsort((row, ident, -score))[:k]
