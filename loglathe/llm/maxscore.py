"""Exact top-k by inner product with MaxScore over sharded inverted lists.

A vector is a bag of terms, its components that are not zero.  In a shard, a
query's weight and a list's largest and smallest values bound what a term can
add.  Terms in ascending order of bounds are non-essential as long as their sum
is below the k-th score so far: a vector in none of the other, essential lists
cannot be among the best.  Essential lists are traversed; the rest is probed for
vectors that remain competitive.  The k-th score goes on from shard to shard of
a block, and blocks' results are merged by query.

Defined results: as in ``grid.integers``; vectors of different lengths have no
score; queries are told apart by row, so a repeated row has its own results, and
repeated rows are candidates for each other; a null vec_id is no query, and as a
candidate comes last in ties; tables without rows give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import grid

K, SCALE, EVERY = 20, 64, 20
#: Vectors of a shard and of the first one, queries at once, and terms probed between looks at what is still competitive.
SHARD, FIRST, ASKED, PROBED = 2048, 256, 256, 4
#: Share of the k-th score that bounds of non-essential terms may reach; below 1, as traversing dense lists costs less than probing.
SPARED = 0.3
#: Sums of products up to which doubles are exact.
EXACT = float(1 << 52)


class Shard:
    """Posting lists of integer vectors, one for each component.

    Lists are held as columns, zero where a vector is not in the list, because
    few components of dense vectors are zero; a product of matrices traverses
    the lists of many queries at once.
    """

    def __init__(self, vectors: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        self.ident, self.row = ident, row
        self.long = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self.whole = vectors
        self.real = vectors.astype(np.float64)
        self.most = np.stack([self.real.max(0, initial=0), -self.real.min(0, initial=0)])

    def competitive(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of all vectors that score the query's ``least`` or more (NaN: all of them).

        Beyond what doubles hold exactly, some that score a little less come too.
        """
        size = float(np.sqrt((queries.astype(np.float64) ** 2).sum(1).max(initial=0))) * self.long
        q, x = (queries.astype(np.float64), self.real) if size < EXACT else (queries, self.whole)
        started = np.flatnonzero(~np.isnan(least))
        fresh = np.flatnonzero(np.isnan(least))
        # nothing can be left out yet: every list is traversed
        plain = q[fresh] @ x.T
        query, place = np.repeat(fresh, len(x)), np.tile(np.arange(len(x)), len(fresh))
        found = [(query, place, plain.reshape(-1).astype(np.int64))]
        if len(started):
            q, wanted = q[started], least[started]
            if size >= EXACT:
                wanted = wanted - np.abs(wanted) * 1e-12
            bound = np.abs(q) * np.where(q < 0, self.most[1], self.most[0])
            order = np.argsort(bound, axis=1, kind="stable")
            below = np.cumsum(np.take_along_axis(bound, order, 1), axis=1) * (1 + 1e-12)
            spare = below < SPARED * wanted[:, None]  # of terms in order
            count = spare.sum(1)
            rest = np.where(spare, below, 0).max(1, initial=0)
            essential = q.copy()
            np.put_along_axis(essential, order, np.where(spare, 0, np.take_along_axis(q, order, 1)), 1)
            sums = essential @ x.T
            query, place = np.nonzero(sums >= (wanted - rest)[:, None])
            score = sums[query, place]
            for at in range(int(count.max(initial=0)) - 1, -1, -PROBED):  # by falling bounds
                for i in range(at, max(-1, at - PROBED), -1):
                    term = order[query, i]
                    score = score + np.where(i < count[query], x[place, term] * q[query, term], 0)
                after = below[:, at - PROBED] if at >= PROBED else np.zeros(len(q))
                left = score + np.minimum(after, rest)[query] >= wanted[query]
                query, place, score = query[left], place[left], score[left]
            enough = score >= wanted[query]
            found.append((started[query[enough]], place[enough], score[enough].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found))


def search(queries: pa.Table, rows: pa.Table, k: int = K) -> list[np.ndarray]:
    """query row, query vec_id, score, vec_id (null: the largest number) and row of each query's k best of a block."""
    out: list[tuple[np.ndarray, ...]] = []
    own_rows = grid.by_length(rows)
    for dim, asked in grid.by_length(queries).items():
        if dim not in own_rows:
            continue
        held = own_rows[dim]
        vectors, (ident, row) = grid.matrix(held.column("vector"), dim), grid.ids(held)
        cuts = [0, *range(min(FIRST, len(row)), len(row), SHARD), len(row)]
        shards = [Shard(vectors[a:b], ident[a:b], row[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        every, (query_ids, query_rows) = grid.matrix(asked.column("vector"), dim), grid.ids(asked)
        for at in range(0, len(every), ASKED):
            own, own_rows_of, own_ids = every[at : at + ASKED], query_rows[at : at + ASKED], query_ids[at : at + ASKED]
            query, score, found, places = (np.zeros(0, np.int64) for _ in range(4))
            least = np.full(len(own), np.nan)
            for shard in shards:
                q, place, more = shard.competitive(own, least)
                other = shard.row[place] != own_rows_of[q]
                q, place, more = q[other], place[other], more[other]
                query, score = np.concatenate((query, q)), np.concatenate((score, more))
                found, places = np.concatenate((found, shard.ident[place])), np.concatenate((places, shard.row[place]))
                order = np.lexsort((places, found, -score, query))
                rank = C.ragged(np.bincount(query, minlength=len(own)))
                order, rank = order[rank < k], rank[rank < k]
                query, score, found, places = query[order], score[order], found[order], places[order]
                last = rank == k - 1
                least[query[last]] = score[last]
            out.append((own_rows_of[query], own_ids[query], score, found, places))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def top(df: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose vec_id ``every`` divides."""
    rows = grid.integers(df, scale)
    asked, others = grid.pairs(rows.where(F.col("vec_id") % every == 0), rows)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        query, ident, score, found, place = search(queries, candidates, k)
        return pa.table({"query": query, "query_id": ident, "score": score, "vec_id": grid.identifiers(candidates, found, place), "row": place})

    met = asked.groupBy("cell").cogroup(others.groupBy("cell")).applyInArrow(run, "query long, query_id long, score long, vec_id long, row long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: Every pair scored plainly.
SQL = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id % {EVERY} = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM t WHERE place <= {K}
"""
