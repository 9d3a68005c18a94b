"""Connected components, and exact comparison of all pairs of a component in blocks.

Components are found by alternating large-star and small-star steps; no
component, group or list of links is ever brought to one task or the driver.
A large component is cut into blocks, and each pair of blocks is a task of its
own, which returns a count and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows, and units of payload, of a block.
BLOCK_ROWS, BLOCK_COST = 2048, 2_000_000


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, root (the smallest node that its links reach) for every node that has a link.

    ``edges``: columns u, v (long), in either direction, repeated or not.
    """
    e = C.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = size = None
    for _ in range(most_steps):
        size = 2 * (e.count() if size is None else before[0])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = C.hot_join(both.where("v > u"), least, ["u"], size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node has few smaller neighbours left here: the least ones of its former neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").select("u", "v", "m")
        small = near.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        past, e = e, C.stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0x7FFFFFFF))).first()
        C.discard(past)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def leads(members: DataFrame, least: str) -> DataFrame:
    """``members`` (id, root, and a column ``least``) with the smallest of that column in their component as ``lead``."""
    firsts = members.groupBy("root").agg(F.min(least).alias("lead"), F.count("*").alias("c"))
    return C.hot_join(members, firsts, ["root"], members.count())


def cut(members: DataFrame, rows: int = BLOCK_ROWS, cost: int = BLOCK_COST) -> DataFrame:
    """``members`` (id, root, weight, cost) with their component's number of blocks and their own block."""
    need = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("cost") / cost)).cast("int")
    counted = members.groupBy("root").agg(need.alias("blocks"), F.count("*").alias("c"))
    return C.hot_join(members, counted, ["root"], members.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def spanning(adjacent: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency the first node of its component."""
    n = len(adjacent)
    label = np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        label[first] = first
        todo = [first]
        while todo:
            found = np.flatnonzero(adjacent[todo.pop()] & free)
            free[found] = False
            label[found] = first
            todo += found.tolist()
    return label


def linked(items: DataFrame, kernel: Callable[[list, list | None], np.ndarray]) -> DataFrame:
    """id, links, anchor: exact links of each item with all others of its component.

    ``items``: id, root, weight, blocks, block, payload (binary).  ``kernel`` takes
    the payloads of one block, or of two, and returns a boolean matrix of links.
    An item's rows add up to its links, weighted; its anchors (an item that links
    reach, itself included) connect what links connect.
    """
    spread = items.select("id", "root", "weight", "block", "payload", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = spread.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "weight", "payload")
    n = C.tasks(items.sparkSession)

    def solve(rows: list[tuple]) -> tuple[list, list, list]:
        i, j = rows[0][1], rows[0][2]
        rows = list({(r[3], r[4]): r for r in sorted(rows, key=lambda r: (r[3], r[4], r[6]))}.values())  # repeated rows once
        ids = np.array([r[4] for r in rows], np.int64)
        weight = np.array([r[5] for r in rows], np.int64)
        block = np.array([r[3] for r in rows])
        if i == j:
            near = kernel([r[6] for r in rows], None)
            np.fill_diagonal(near, False)
        else:
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = np.zeros((len(rows), len(rows)), bool)
            if len(a) and len(b):
                found = kernel([rows[k][6] for k in a], [rows[k][6] for k in b])
                near[np.ix_(a, b)] = found
                near[np.ix_(b, a)] = found.T
        links = near.astype(np.float32) @ weight.astype(np.float32) if weight.sum() < 1 << 24 else near @ weight
        return ids.tolist(), np.rint(links).astype(np.int64).tolist(), ids[spanning(near)].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, held = None, [], ([], [], []), 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "links", "anchor"])
            for x in out:
                x.clear()
            return done

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if rows:
                        for to, got in zip(out, solve(rows)):
                            to += got
                    key, rows = row[:3], []
                    if len(out[0]) > 10_000:
                        yield flush()
                rows.append(row)
        if rows:
            for to, got in zip(out, solve(rows)):
                to += got
        yield flush()
        C.release()

    return pairs.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "id long, links long, anchor long")
