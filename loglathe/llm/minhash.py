"""N-gram Jaccard join by MinHash banding.

Shingles are five successive words; a text of one to four words has one
shingle, all of it.  Texts with the same set of shingles are one class, which
its smallest doc_id represents.  Band and row counts are the cheapest that
reach a target recall at the similarity asked for.  Bands are shuffled as
hashes alone; what shares a band is linked in a star, the stars' components are
found, and all pairs of each component are verified on their full sets of
shingles, large components in blocks.

Defined results: null texts and texts without words have no shingles, link
with nothing and are kept; equal texts are one class; repeated rows are
copies, of which one is kept; other text under a repeated doc_id is a document
of its own; a null doc_id represents a class or component only where it has no
other; tables without rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import graph

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: A pair of this similarity may at most so often share a band.
FAR, FAR_SHARE = 0.3, 0.15
#: Texts that are sorted at once; a shingle's hash has 52 bits beside the text's number.
TEXTS = 4096


def banding(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): fewest hashes with that recall at that similarity, dissimilar pairs rarely sharing a band."""
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - FAR**rows) ** bands <= FAR_SHARE:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def shingles(data: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle hashes of each text in order, one after the other, and shingles per text."""
    starts, ends, per = C.words(data, offs)
    h = C.span_hash(data, starts, ends)
    whole, doc = C.in_text(per, size)
    found, owner = C.window_hash(h, size)[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        firsts = (np.cumsum(per) - per)[short]
        with np.errstate(over="ignore"):
            one = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                have = per[short] > k
                one[have] = one[have] * np.uint64(C._BASE) + h[firsts[have] + k]
        found = np.concatenate([found, C.mix(one + per[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    keys = (owner.astype(np.uint64) << np.uint64(52)) | (found >> np.uint64(12))
    keys.sort()
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64((1 << 52) - 1), np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(per))


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def signatures(df: DataFrame, bands: int, rows: int, size: int = WORDS) -> DataFrame:
    """row, doc_id, s1, s2 (hashes of the set of shingles), n, bands (a hash each)."""
    seeds = np.random.RandomState(7).randint(1, 1 << 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found, n = shingles(*C.buffers(batch.column("text")), size)
            some = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(n), bands), np.uint64)
            if len(some):
                at = (np.cumsum(n) - n)[some]
                low = C.mix(found)
                with np.errstate(over="ignore"):
                    s1[some] = np.add.reduceat(low, at)
                    s2[some] = np.add.reduceat(C.mix(low ^ np.uint64(0x5851F42D4C957F2D)), at)
                    half = (low >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        h = np.zeros(len(some), np.uint64)
                        for r in range(rows):
                            x = half * seeds[b * rows + r]
                            x ^= x >> np.uint32(15)
                            h = h * np.uint64(C._BASE) + np.minimum.reduceat(x, at)
                        keys[some, b] = C.mix(h)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(C.signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(C.signed(s1)), pa.array(C.signed(s2)), pa.array(n, pa.int64()), lists], ["row", "doc_id", "s1", "s2", "n", "bands"])

    return df.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, s1 long, s2 long, n long, bands array<long>")


def jaccard(similarity: float):
    """The kernel that compares sets of shingles exactly: intersections as products of 0/1 matrices."""

    def run(left: list, right: list | None) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in left + (right or [])]
        sizes = np.array([len(s) for s in sets])
        a = len(left)
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            near = both >= similarity * (sizes[0] + sizes[1] - both) - 1e-9
            return np.array([[near]]) if right else np.array([[True, near], [near, True]])
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = times[column] > 1
        column, owner = column[shared], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        if len(column):
            column = np.cumsum(np.append(0, (column[1:] != column[:-1]).astype(np.int64)))
        both = np.zeros((a, len(right) if right else a), np.float32)
        width = min(4096, int(column[-1]) + 1) if len(column) else 1
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [first, first + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[lo:hi], column[lo:hi] - first] = 1
            both += dense[:a] @ (dense[a:] if right else dense).T
        union = sizes[:a, None] + (sizes[a:] if right else sizes)[None, :] - both
        return both >= similarity * union - 1e-6

    return run


def neighbours(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = WORDS) -> DataFrame:
    """doc_id, class_id, class_size, n_links, component_id, kept.

    class_id: the smallest doc_id with the same set of shingles; n_links: other
    documents of at least that similarity, copies included; component_id: the
    smallest doc_id that links reach; kept: one row of each component, the first
    with that doc_id.
    """
    return of_rows(C.numbered(df, "doc_id", "text"), similarity, recall, size).drop("row")


def of_rows(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = WORDS) -> DataFrame:
    """``neighbours`` of a stored table with a column ``row`` that numbers its rows; the result has it too."""
    bands, rows = banding(similarity, recall)
    sig = C.stored(signatures(docs, bands, rows, size), "signatures")
    some = sig.where("n > 0")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")  # null identifiers last
    classes = C.stored(some.select("s1", "s2", "row", "n", mine.alias("mine")).groupBy("s1", "s2").agg(F.min("row").alias("id"), F.min("mine").alias("own"), F.count("*").alias("weight"), F.max("n").alias("cost")), "classes")
    banded = C.stored(some.select("row", "bands").join(classes.select(F.col("id").alias("row")), "row").select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "key")), "bands")
    full = banded.groupBy("band", "key").agg(F.min("id").alias("v"), F.count("*").alias("c")).where("c > 1")
    stars = C.hot_join(banded, full, ["band", "key"], banded.count()).where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    found = graph.components(stars)
    members = C.stored(classes.select("id", "weight", "cost").join(found.withColumnRenamed("node", "id"), "id").select("id", "root", "weight", "cost"), "members")
    placed = graph.cut(members)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            got, n = shingles(*C.buffers(batch.column("text")), size)
            ends = np.concatenate([[0], np.cumsum(n)]) * 8
            raw = got.tobytes()
            payload = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "root", "weight", "blocks", "block")), payload], ["id", "root", "weight", "blocks", "block", "payload"])

    # by shuffled hash at every size, built of the members: the texts are neither sorted nor broadcast to
    texts = docs.select(F.col("row").alias("id"), "text").join(placed.hint("shuffle_hash"), "id").select("id", "root", "weight", "blocks", "block", "text")
    items = texts.mapInArrow(pack, "id long, root long, weight long, blocks int, block int, payload binary").where(F.length("payload") > 0)
    links = C.stored(graph.linked(items, jaccard(similarity)), "links")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    joined = graph.components(links.select(F.col("id").alias("u"), F.col("anchor").alias("v"))).select(F.col("node").alias("id"), "root")
    # classes that link with no other are their own components
    reached = C.stored(classes.join(counted, "id", "left").join(joined, "id", "left").select("s1", "s2", "id", F.coalesce("root", "id").alias("root"), "own", "weight", F.coalesce("links", F.lit(0)).alias("links")), "reached")
    ends = graph.leads(reached, "own").select("s1", "s2", F.col("own.doc_id").alias("class_id"), F.col("weight").alias("class_size"), (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("first"))
    linked = some.select("row", "doc_id", "s1", "s2").join(ends, ["s1", "s2"]).withColumn("kept", F.col("row") == F.col("first")).drop("s1", "s2", "first")
    alone = sig.where("n = 0").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(C.table(spark, sf_dir, "documents", "doc_id", "text"))
