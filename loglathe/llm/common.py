"""Shared helpers of the training-data operators.

Texts are handled as Arrow string buffers: a chunk is one uint8 array and an
offsets array, and words, hashes and n-grams are computed for all texts of a
chunk at once.  Null texts count as empty everywhere.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once; numpy temporaries take about 60 times as much.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd
#: Hashes of spans are polynomials over the field of this prime, at two points.
_PRIME, _POINTS = (1 << 31) - 1, (0x3C6EF372, 0x1B873593)
#: Bytes up to which sums of products stay under 64 bits.
_SUMMED = 1 << 23
_powers: dict[int, np.ndarray] = {}


# ------------------------------------------------------------------ storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (tests on one machine), a temporary folder is
    made and set; on a cluster the setting has to be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, stored, and ``row``, a number of its own for each row, whatever its identifier."""
    return stored(df.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], size: int, share: int = 1000) -> DataFrame:
    """Inner join with ``right``, one row a key, whose ``c`` counts the key's rows in ``left`` (``size`` rows).

    Keys with more than one row in ``share`` are at most ``share``, so they are
    broadcast and their rows stay where they are; only the others are shuffled.
    """
    hot = right.where(F.col("c") * share > F.lit(size))
    known = F.broadcast(hot.select(*on))
    few = left.join(F.broadcast(hot.drop("c")), on)
    rest = left.join(known, on, "left_anti").join(right.where(F.col("c") * share <= F.lit(size)).drop("c"), on)
    return few.unionByName(rest)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# ------------------------------------------------------------------ buffers
def release() -> None:
    """Give memory that a task no longer needs back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches so that a piece holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pa.default_memory_pool().release_unused()
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())))
        at = 0
        while at < n:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and n + 1 offsets (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


# -------------------------------------------------------------------- words
#: The bytes between words.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_IN_WORD = np.ones(256, np.uint8)
_IN_WORD[SPACES] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and words per text; words never cross texts."""
    inside = _IN_WORD[data]
    before = np.zeros(len(data) + 1, np.uint8)
    before[1:] = inside
    edges = offs[offs < len(data)]
    before_start = before[:-1].copy()
    before_start[edges] = 0
    starts = np.flatnonzero(inside > before_start)
    after = np.zeros(len(data), np.uint8)
    after[:-1] = inside[1:]
    lasts = offs[1:][offs[1:] > 0] - 1
    after[lasts] = 0
    ends = np.flatnonzero(inside > after) + 1
    per = np.diff(np.searchsorted(starts, offs))
    return starts, ends, per


def _power(point: int, n: int) -> np.ndarray:
    """The first n powers of a point, modulo the prime."""
    have = _powers.get(point)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.ones(size, _U)
        done, step = 1, point
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * _U(step) % _U(_PRIME)
            done, step = done + more, step * step % _PRIME
        _powers[point] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h = h * _U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> _U(27))
        h = h * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, 2**31 - 1: bits above are added to those below."""
    x = (x & _U(_PRIME)) + (x >> _U(31))
    x = (x & _U(_PRIME)) + (x >> _U(31))
    x[x >= _U(_PRIME)] -= _U(_PRIME)
    return x


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's content; a function of the content alone.

    Two polynomials over a prime field and the length: unlike one modulo 2**64,
    no pattern of bytes makes many spans collide.
    """
    n = len(data)
    x = data.astype(_U)
    x += _U(1)
    both = np.zeros(len(starts), _U)
    terms, sums = np.empty(n, _U), np.zeros(n + 1, _U)
    for point in _POINTS:
        np.multiply(x, _power(point, n), out=terms)
        if n > _SUMMED:
            terms %= _U(_PRIME)
        np.cumsum(terms, out=sums[1:])
        h = _reduced(_reduced(sums[ends] - sums[starts]) * _power(pow(point, -1, _PRIME), n + 1)[starts])
        both = both << _U(31) | h
    with np.errstate(over="ignore"):
        return mix(both + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive hashes; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for i in range(k):
            out = out * _U(_BASE) + h[i : i + n]
        return mix(out)


def in_text(per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of k items stay in one text, and the text of each item."""
    doc = np.repeat(np.arange(len(per)), per)
    n = len(doc) - k + 1
    return (doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)), doc


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + l] for each span, one after the other."""
    return values[np.repeat(starts, lengths) + ragged(lengths)]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def with_columns(df: DataFrame, through: tuple[str, ...], more: str) -> T.StructType:
    """The schema of the columns ``through`` and those of the DDL string ``more``."""
    return T.StructType([df.schema[c] for c in through] + (T.StructType.fromDDL(more).fields if more else []))
