"""Best-fit packing: patterns of few lengths, fitted by non-negative least squares.

Documents become token sequences; longer ones than a sequence are cut, the
first piece taking the remainder.  The histogram of piece lengths (at most
``size`` numbers, whatever the corpus) goes to the driver, where patterns of
one to three lengths that fill a sequence are enumerated, their repeat counts
fitted to the histogram by non-negative least squares, and rounded down; the
residual histogram is packed best fit, longest first, by counts.  The plan has
a few rows for each length.  Each piece then takes its place by its rank among
the pieces of its length, which partitions and prefix sums give without
sorting or collecting pieces.

Defined results: a null or empty text is its end token alone; rows with equal
doc_id are packed as separate documents; tables without rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bpe
from . import common as C

SIZE = 2048
#: Lengths that the second of three may take in a pattern: one of each so many.
STEP = 64
ROUNDS = 300

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row for each piece, with its rank among those of its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path, fast=True)
        seen = np.zeros(size + 1, np.int64)
        part = None
        for batch in C.chunks(batches):
            part = batch.column("part")[0].as_py() if part is None else part
            data, offs = C.buffers(batch.column("text"))
            ids, per = e.encode(data, offs)
            ends = np.cumsum(per)
            ids = np.insert(ids, ends, end_id)
            total = per + 1
            firsts = np.cumsum(total) - total
            n = -(-total // size)
            number = C.ragged(n)
            head = np.repeat(total - (n - 1) * size, n)
            start = np.where(number == 0, 0, head + (number - 1) * size)
            length = np.where(number == 0, head, size)
            packed = memoryview(ids.astype("<u4").tobytes())
            a = 4 * (np.repeat(firsts, n) + start)
            crc = [zlib.crc32(packed[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            _, index, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = seen[length[order]] + np.arange(len(order)) - np.repeat(index, count)
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(per)), n))), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(length), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return df.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------------- plan
def patterns(size: int, step: int = STEP) -> np.ndarray:
    """Rows of three lengths, 0 for none, that add up to ``size``."""
    two = np.arange(1, size // 2 + 1)
    found = [np.stack([size - two, two, np.zeros_like(two)], 1)]
    for b in range(step // 2, size // 2 + 1, step):
        c = np.arange(1, size - b)
        found.append(np.stack([size - b - c, np.full_like(c, b), c], 1))
    rows = np.sort(np.concatenate(found), axis=1)[:, ::-1]
    return np.unique(rows[rows[:, 0] > 0], axis=0)


def nnls(cols: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings the lengths used by patterns near the histogram, by projected gradient steps with momentum."""
    n = len(histogram)
    used = lambda x: sum(np.bincount(cols[:, i], x, n) for i in range(cols.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return sum(r[cols[:, i]] for i in range(cols.shape[1]))

    v = np.ones(len(cols))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    x = y = np.zeros(len(cols))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - histogram) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(rest: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: (lengths in a sequence, how many such sequences)."""
    free: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(len(rest) - 1, 0, -1):
        left = int(rest[length])
        while left:
            room = next((r for r in range(length, size) if free.get(r)), None)
            if room is None:
                each = size // length
                whole, more = divmod(left, each)
                for lengths, k in (((length,) * each, whole), ((length,) * more, 1)):
                    if k and lengths:
                        own = free.setdefault(size - length * len(lengths), {})
                        own[lengths] = own.get(lengths, 0) + k
                break
            lengths, k = free[room].popitem()
            each = room // length
            whole = min(k, left // each)
            if whole:
                put, used, k = lengths + (length,) * each, whole, k - whole
            else:
                each, used, put, k = left, 1, lengths + (length,) * left, k - 1
            if k:
                free[room][lengths] = k
            own = free.setdefault(room - each * length, {})
            own[put] = own.get(put, 0) + used
            left -= used * each
    return [x for own in free.values() for x in own.items()]


def plan(histogram: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from ``rank`` on go to successive sequences."""
    rest = histogram.astype(np.int64).copy()
    bins: list[tuple[tuple[int, ...], int]] = [((size,), int(rest[size]))] if rest[size] else []
    rest[size] = 0
    if rest.any():
        cols = patterns(size)
        x = nnls(cols, rest.astype(float))
        for i in np.argsort(-x, kind="stable"):
            k = int(round(x[i]))
            if k < 1:
                break
            lengths = tuple(int(a) for a in cols[i] if a)
            k = min([k, *(int(rest[a]) // lengths.count(a) for a in set(lengths))])
            if k:
                bins.append((lengths, k))
                for a in lengths:
                    rest[a] -= k
        bins += best_fit(rest, size)
    taken = np.zeros(size + 1, np.int64)
    rows, first = [], 0
    for lengths, k in bins:
        at = 0
        for a in lengths:
            rows.append((a, int(taken[a]), first, at))
            taken[a] += k
            at += a
        first += k
    if (taken != histogram).any():
        raise AssertionError("the plan must place every piece")
    found = np.array(rows, np.int64).reshape(-1, 4)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return {"length": found[:, 0], "rank": found[:, 1], "sequence": found[:, 2], "offset": found[:, 3], "sequences": np.array([first])}


def pack(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """PIECES without part and rank, with sequence_id and offset."""
    spark = df.sparkSession
    cut = C.stored(pieces(df, path, size, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = C.stored(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = np.zeros(size + 1, np.int64)
    for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row["length"]] = row["n"]
    made = spark.sparkContext.broadcast(plan(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = made.value
        keys = p["length"] << 44 | p["rank"]
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank")) + np.asarray(batch.column("base"))
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = p["sequence"][i] + rank - p["rank"][i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(p["offset"][i])], schema.names)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    schema = T.StructType.fromDDL(kinds)
    return cut.join(base.select("length", "part", "base").hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base").mapInArrow(place, kinds)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
