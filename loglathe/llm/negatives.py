"""Hard negatives by inverted lists of k-means clusters with stored radii.

Centroids are fitted on a bounded sample; every row is put into the list of its
nearest centroid, and lists are cut into blocks.  A block stores its centroid
and radius, the largest distance of its rows from it, so that by Cauchy-Schwarz
a query's inner product with any row lies within |query| * radius of that with
the centroid.  A search visits blocks by falling upper bounds, skips those whose
bounds lie outside the wanted window, and stops when the bound falls strictly
below the k-th score.  Positives are the best rows of an anchor's label;
negatives are the best rows of other labels with scores in the window that the
positive's score sets.  Groups of lists are merged by anchor and positive.

Defined results: as in ``grid.integers``; rows with a null label take no part;
vectors of different lengths have no score; anchors are told apart by row, so a
repeated row has its own results, and repeated rows are rows of their own; a
null vec_id is no anchor, and comes last in ties; a window is empty where the
positive's score is negative; tables without rows give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import grid

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's share of the positive's score, in hundredths.
LOW, HIGH = 30, 90
#: Rows that centroids are fitted on at most, clusters, rounds, rows of a piece of a list, and of a block of a piece.
SAMPLE, CLUSTERS, ROUNDS, PIECE, BLOCK = 20_000, 256, 8, 4096, 1024
#: Slack for rounding in bounds, relative and absolute.
SLACK = 1e-9


# ---------------------------------------------------------------- clusters
def centroids(rows: DataFrame, sample: int = SAMPLE, most: int = CLUSTERS) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, by k-means over a sample of ``sample`` rows.

    The sample holds the rows of the smallest hashes; it decides how well lists
    prune, never which rows are found.
    """
    spread = F.xxhash64("vec_id", "row")
    chosen = rows.select("vector", spread.alias("h"), "row").orderBy("h", "row").limit(sample).select("vector").toArrow()
    fitted = {}
    for dim, own in grid.by_length(chosen).items():
        x = grid.matrix(own.column("vector"), dim).astype(np.float64)
        k = max(1, min(most, math.isqrt(len(x))))
        centre = x[:: max(1, len(x) // k)][:k].copy()
        for _ in range(ROUNDS):
            near = nearest(x, centre)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, x)
            count = np.bincount(near, minlength=len(centre))
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
        fitted[dim] = centre
    return fitted


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1)[None, :] - 2 * (x @ centre.T), axis=1) if centre.shape[1] else np.zeros(len(x), np.int64)


def listed(rows: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """The rows with ``cluster``, that of the nearest centroid (0 for lengths without), and ``piece``, cut from long lists; stored."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.zeros(batch.num_rows, np.int32)
            lengths = np.asarray(batch.column("vector").value_lengths())
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                if dim in centre:
                    cluster[own] = nearest(grid.matrix(batch.column("vector").take(pa.array(own)), dim).astype(np.float64), centre[dim])
            yield batch.append_column("cluster", pa.array(cluster))

    kept = C.stored(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())])), "listed")
    sizes = kept.groupBy("cluster").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    return kept.join(sizes, "cluster").withColumn("piece", F.xxhash64("cluster", F.pmod(F.xxhash64("row"), F.col("pieces")))).drop("pieces")


class Lists:
    """Inverted lists over integer vectors of one length, in blocks with centroid and radius."""

    def __init__(self, table: pa.Table, dim: int, centre: np.ndarray | None) -> None:
        x = grid.matrix(table.column("vector"), dim)
        ident, row = grid.ids(table)
        label, near = (np.asarray(table.column(c).combine_chunks(), dtype=np.int64) for c in ("label", "cluster"))
        if centre is None:  # a length that the sample has not
            centre = np.zeros((1, dim))
        order = np.argsort(near, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(near[order]) != 0))
        self.blocks, middles, radii = [], [], []
        for own in np.split(order, cut[1:]):
            for at in range(0, len(own), BLOCK):
                some = own[at : at + BLOCK]
                middle = centre[near[some[0]]]
                middles.append(middle)
                radii.append(math.sqrt(float(((x[some] - middle) ** 2).sum(1).max())))
                real = x[some].astype(np.float64)
                exact = float((real**2).sum(1).max()) < (1 << 50)  # products are summed in doubles where that is exact
                self.blocks.append((real if exact else x[some], ident[some], row[some], label[some], exact))
        self.middle, self.radius = np.array(middles).reshape(len(middles), dim), np.array(radii)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each block's rows can have with the query."""
        q = query.astype(np.float64)
        mid, reach = self.middle @ q, math.sqrt(float(q @ q)) * self.radius
        slack = SLACK * (np.abs(mid) + reach) + 1e-6
        return mid - reach - slack, mid + reach + slack

    def scores(self, block: int, query: np.ndarray, real: np.ndarray, short: bool) -> np.ndarray:
        vectors, _, _, _, exact = self.blocks[block]
        if exact:
            return (vectors @ real).astype(np.int64) if short else vectors.astype(np.int64) @ query
        return vectors @ query

    def best(self, query: np.ndarray, k: int, wanted, windows: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each window, score, vec_id and row of the k best rows that ``wanted(rows, labels)`` allows, scores from low to high."""
        floor, ceiling = self.bounds(query)
        real = query.astype(np.float64)
        short = float(real @ real) < (1 << 50)
        held = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in windows]
        least = [low for low, _ in windows]  # what a row needs; the k-th score once there are k
        for b in np.argsort(-ceiling, kind="stable").tolist():
            top = ceiling[b]
            if all(top < x for x in least):
                break
            open_now = [w for w, (_, high) in enumerate(windows) if top >= least[w] and floor[b] <= high]
            if not open_now:
                continue
            _, idents, rows, labels, _ = self.blocks[b]
            score = self.scores(b, query, real, short)
            allowed = wanted(rows, labels) & (score >= min(least[w] for w in open_now))
            some = np.flatnonzero(allowed)
            if not len(some):
                continue
            score = score[some]
            for w in open_now:
                inside = np.flatnonzero((score >= least[w]) & (score <= windows[w][1]))
                if len(inside):
                    own = some[inside]
                    joined = tuple(np.concatenate(x) for x in zip(held[w], (score[inside], idents[own], rows[own])))
                    first = grid.best(*joined, k)
                    held[w] = tuple(x[first] for x in joined)
                    if len(first) == k:
                        least[w] = int(held[w][0][-1])
        return held


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


# ------------------------------------------------------------------ mining
def _searched(asked: DataFrame, others: DataFrame, centre: dict[int, np.ndarray], find, schema: str) -> DataFrame:
    """``find(lists, query table)`` for each block of anchors and of rows, by length of vectors.

    The last two columns are the identifier and the row of what was found.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in names]
        held = grid.by_length(rows)
        for dim, own in grid.by_length(queries).items():
            if dim in held:
                for line in find(Lists(held[dim], dim, centre.get(dim)), own, dim):
                    for column, value in zip(found, line):
                        column.append(value)
        values = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        place = values[-1]
        return pa.table({c: grid.identifiers(rows, v, place) if c == names[-2] else pa.array(v, pa.int64()) for c, v in zip(names, values)})

    return asked.groupBy("cell").cogroup(others.groupBy("cell")).applyInArrow(run, schema)


def mine(df: DataFrame, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over columns vec_id, embedding, label."""
    rows = grid.integers(df.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("long").alias("label")), scale, "label")
    centre = centroids(rows)
    lists = C.stored(listed(rows, centre), "lists")
    anchors = rows.where(F.col("vec_id") % every == 0)

    def same(lists: Lists, table: pa.Table, dim: int):
        ident, row = grid.ids(table)
        label = np.asarray(table.column("label").combine_chunks(), dtype=np.int64)
        for q, query in enumerate(grid.matrix(table.column("vector"), dim)):
            score, other, place = lists.best(query, positives, lambda r, l, q=q: (l == label[q]) & (r != row[q]), [(-math.inf, math.inf)])[0]
            yield np.full(len(score), row[q]), score, other, place

    asked, others = grid.pairs(anchors, lists, together="piece")
    near = _searched(asked, others, centre, same, "row long, positive_score long, positive_id long, positive_row long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    chosen = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = C.stored(anchors.join(chosen, "row"), "positives")

    def other(lists: Lists, table: pa.Table, dim: int):
        _, row = grid.ids(table)
        order = np.argsort(row, kind="stable")
        table, row = table.take(pa.array(order)), row[order]
        label, score_of, place_of = (np.asarray(table.column(c).combine_chunks(), dtype=np.int64) for c in ("label", "positive_score", "place"))
        vectors = grid.matrix(table.column("vector"), dim)
        for own in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):  # an anchor's positives
            own = own[score_of[own] >= 0]
            if not len(own):
                continue
            q = own[0]
            found = lists.best(vectors[q], negatives, lambda r, l, q=q: l != label[q], [window(int(s), low, high) for s in score_of[own]])
            for i, (score, other, place) in zip(own, found):
                yield np.full(len(score), row[q]), np.full(len(score), place_of[i]), score, other, place

    asked, others = grid.pairs(pairs, lists, positives, "piece")
    far = _searched(asked, others, centre, other, "row long, place long, negative_score long, negative_id long, negative_row long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    known = pairs.select("row", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return known.join(ranked, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.withColumn("label", moved))


#: Every pair scored plainly.
SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score
      FROM v a JOIN v r ON a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS place
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= {POSITIVES}
                    AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= {NEGATIVES}
"""
