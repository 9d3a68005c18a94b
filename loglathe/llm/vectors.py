"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

Each distinct unit vector o is rotated at random several times; a rotation's
code holds the signs of o' = P o, and its correction factor is <x, o'>, x being
the code's unit vector.  <x, q'> / <x, o'> then estimates <o, q> without bias,
and sqrt((1 - f^2) / f^2 / (d - 1)) bounds its deviation.  Pieces of the codes are
bucket keys; within a bucket the estimates' confidence bounds decide which
pairs need exact recomputation.  The components of those pairs, a few vectors
each, are recomputed exactly in double precision, large ones in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows whose label is null, link with nothing and are kept;
vectors of other lengths never link; repeated rows are copies of each other;
other vectors under a repeated vec_id are vectors of their own, all kept if that
is their component's smallest; a null vec_id is a component's only where it has
no other; tables without rows give no rows; extra columns are ignored.
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

COSINE = 0.98
#: Deviations of the estimate that the confidence bound allows, and the share of pairs at the threshold that may share no bucket.
SIGMAS, MISSED = 4.0, 1e-7
#: Bucket rows that are compared all at once; larger buckets walk from vector to vector.
SMALL = 24


def keying(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(bits of a key, keys): more bits for more vectors, and as many keys as the missed share asks for."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def rotation(dim: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(1000 + number).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def estimate(signs: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products of each code's vector with each rotated vector, and each code's bound."""
    d = signs.shape[1]
    est = (signs @ rotated.T) / (math.sqrt(d) * factor[:, None])
    return est, SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1))


def coded(df: DataFrame, bits: int, keys: int) -> DataFrame:
    """id, label, dim, which key, its value, and the rotated vector in 8 bits, whose signs are the code, with its scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("vector").value_lengths())
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 2000):
                    rows = batch.take(pa.array(own[at : at + 2000]))
                    x = np.asarray(rows.column("vector").flatten(), dtype=np.float64).reshape(-1, dim)
                    x = x / np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    each = max(1, dim // bits)
                    for r in range(-(-keys // each)):
                        turned = x @ rotation(int(dim), r).T
                        sign = (turned >= 0).astype(np.int64)
                        top = np.abs(turned).max(1, keepdims=True)
                        level = np.rint(turned / top * 127).astype(np.int8)
                        level = np.where(sign == 1, np.maximum(level, 0), np.minimum(level, -1)).astype(np.int8)
                        raw = level.tobytes()
                        payload = pa.array([raw[i : i + dim] for i in range(0, len(raw), dim)], pa.binary())
                        scale = pa.array((top[:, 0] / 127).astype(np.float32))
                        factor = pa.array((np.abs(turned).sum(1) / math.sqrt(dim)).astype(np.float32))
                        for k in range(min(each, keys - r * each)):
                            piece = sign[:, k * bits : (k + 1) * bits]
                            value = piece @ (1 << np.arange(piece.shape[1], dtype=np.int64))
                            n = rows.num_rows
                            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array(np.full(n, r * each + k, np.int32)), pa.array(value), payload, scale, factor], ["id", "label", "which", "value", "code", "scale", "factor"])

    return df.select("id", "label", "vector").mapInArrow(run, "id long, label long, which int, value long, code binary, scale float, factor float")


def undecided(df: DataFrame) -> DataFrame:
    """u, v: links of a forest over the pairs of a bucket whose bounds reach the threshold."""

    def bucket(rows: list[tuple], us: list, vs: list) -> None:
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r[4]), []).append(r)
        for own in by_dim.values():
            if len(own) < 2:
                continue
            ids = np.array([r[0] for r in own], np.int64)
            level = np.frombuffer(b"".join(r[4] for r in own), np.int8).reshape(len(own), -1)
            turned = level * np.array([r[5] for r in own], np.float32)[:, None]
            signs = np.where(level >= 0, 1, -1).astype(np.float32)
            factor = np.array([r[6] for r in own], np.float32)
            bound = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, level.shape[1] - 1)) + 0.01
            root = math.sqrt(level.shape[1])
            if len(own) <= SMALL:
                est = (signs @ turned.T) / (root * factor[:, None])
                near = est + bound[:, None] >= COSINE
                near &= near.T
                label = graph.spanning(near)
                some = np.flatnonzero(label != np.arange(len(own)))
                us += ids[some].tolist()
                vs += ids[label[some]].tolist()
                continue
            free = np.arange(1, len(own))
            todo = [0]
            while len(free) or todo:
                if not todo:
                    todo, free = [free[0]], free[1:]
                    continue
                i = todo.pop()
                one = (signs[i] @ turned[free].T) / (root * factor[i]) + bound[i] >= COSINE
                two = (signs[free] @ turned[i]) / (root * factor[free]) + bound[free] >= COSINE
                got = free[one & two]
                free = free[~(one & two)]
                us += ids[got].tolist()
                vs += [int(ids[i])] * len(got)
                todo += got.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, us, vs = None, [], [], []
        names = ("id", "label", "which", "value", "code", "scale", "factor")
        for batch in batches:
            key = [np.asarray(batch.column(c)) for c in ("label", "which", "value")]
            n = batch.num_rows
            fresh = np.ones(n, bool)
            fresh[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            begins = np.append(np.flatnonzero(fresh), n)
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                now = (key[0][a], key[1][a], key[2][a])
                if now != last:
                    if len(rows) > 1:
                        bucket(rows, us, vs)
                    rows, last = [], now
                if b - a > 1 or b == n or rows:  # a row that is alone needs no unpacking
                    part = batch.slice(a, b - a)
                    rows += zip(*(part.column(c).to_pylist() for c in names))
            if len(us) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        if len(rows) > 1:
            bucket(rows, us, vs)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    n = C.tasks(df.sparkSession)
    return df.repartition(n, "label", "which", "value").sortWithinPartitions("label", "which", "value").mapInArrow(run, "u long, v long")


def cosine(least: float):
    """The kernel that recomputes cosines exactly."""

    def run(left: list, right: list | None) -> np.ndarray:
        def unit(rows: list) -> np.ndarray:
            wide = max(map(len, rows)) // 8
            out = np.zeros((len(rows), wide))
            for i, r in enumerate(rows):
                v = np.frombuffer(r, np.float64)
                v = v / np.abs(v).max()
                out[i, : len(v)] = v / np.sqrt(v @ v)
            return out

        a = unit(left)
        b = unit(right) if right else a
        wide = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))
        near = a @ b.T >= least
        near &= np.array([len(x) for x in left])[:, None] == np.array([len(x) for x in (right or left)])[None, :]
        return near

    return run


def neighbours(df: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept over columns vec_id, embedding, label."""
    base = df.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("vector", lambda x: x != 0)
    good = base.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    # -0.0 + 0.0 is 0.0, so that equal vectors have equal digests
    digest = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    keyed = C.stored(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector", digest.alias("digest")), "vectors")
    classes = C.stored(keyed.groupBy("label", "digest").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("weight")), "classes")
    lead = C.stored(keyed.select(F.col("row").alias("id"), "label", "vector").join(classes.select("id", "weight"), "id"), "lead")
    most = lead.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, keys = keying(most, least)
    pairs = undecided(coded(lead, bits, keys))
    found = graph.components(pairs)
    members = C.stored(lead.select("id", "weight", F.size("vector").alias("cost")).join(found.withColumnRenamed("node", "id"), "id"), "members")
    placed = graph.cut(members).select("id", "root", "weight", "blocks", "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [np.asarray(v, np.float64).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "root", "weight", "blocks", "block")), pa.array(payload, pa.binary())], ["id", "root", "weight", "blocks", "block", "payload"])

    items = lead.select("id", "vector").join(placed, "id").select("id", "root", "weight", "blocks", "block", "vector").mapInArrow(pack, "id long, root long, weight long, blocks int, block int, payload binary")
    links = C.stored(graph.linked(items, cosine(least)), "links")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    joined = graph.components(links.select(F.col("id").alias("u"), F.col("anchor").alias("v"))).select(F.col("node").alias("id"), "root")
    reached = C.stored(classes.join(counted, "id", "left").join(joined, "id", "left").select("label", "digest", F.coalesce("root", "id").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "reached")
    ends = graph.leads(reached, "least").select("label", "digest", "n_links", F.col("lead").alias("component_id"))
    alone = base.where(F.col("label").isNull() | ~F.coalesce(finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = keyed.select("vec_id", "label", "digest").join(ends, ["label", "digest"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
