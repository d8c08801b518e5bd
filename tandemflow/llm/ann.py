"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt by a hash into shards of about ``SHARD`` rows.  Each shard's graph is built once, in
one task: points are put in by batches, a greedy beam search from the shard's medoid proposes their
neighbours, and robust pruning keeps an edge only if no kept neighbour is ``ALPHA`` times nearer to
its end, so edges point in different directions; reverse edges are pruned likewise.  The
same task then answers all queries on its shard, which come behind the shard's rows as a stream, by beam search
with a wider beam.  All searches of a batch step together as numpy arrays.  Every shard sends its
best for each query, and the best of all shards remain, measured in double precision on the
original vectors.

A task holds one shard and one batch of queries.  Exact copies of a vector are one node: the graph
holds distinct vectors of a shard, and a node that is found gives all its rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, as query or candidate; vectors of another length than the query's are no candidates for it;
rows with a null id take no part; ties go to the smaller id; with fewer candidates than asked
for, all are given; rows of one id are one candidate, by the nearest of their vectors, and one query, of
the smallest of its vectors (element by element); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .vectors import matrix, usable_rows

SHARD, QUERY_BLOCK = 16384, 512
DEGREE, BEAM, SEARCH_BEAM, ALPHA = 32, 64, 160, 1.2
BATCH = 256


class Graph:
    """Robust-pruned directed graph over the rows of a matrix."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> None:
        self.x, self.degree, self.alpha = x, degree, alpha
        self.square = np.einsum("ij,ij->i", x, x)
        # Room for half as many edges again: a node's list is pruned once for several new reverse edges.
        self.out = np.full((len(x), degree + degree // 2), -1, dtype=np.int64)
        centre = x.mean(axis=0)
        self.entry = int(np.argmin(self.square - 2 * x @ centre))
        order = np.random.default_rng(len(x)).permutation(len(x))
        size = 1
        while len(order):  # small batches first: they see little of each other
            self._insert(order[:size], beam)
            order, size = order[size:], min(2 * size, BATCH)

    def distances(self, queries: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances from each query to its row of points; infinite where there is none."""
        d = self.square[which] - 2 * np.einsum("bd,bkd->bk", queries, self.x[which]) + np.einsum("bd,bd->b", queries, queries)[:, None]
        return np.where(which >= 0, d, np.inf)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, squared distances) of the beam of each query, nearest first, -1 where short."""
        n = len(queries)
        points = np.full((n, beam), -1, dtype=np.int64)
        points[:, 0] = self.entry
        near = np.full((n, beam), np.inf)
        near[:, :1] = self.distances(queries, points[:, :1])
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[:, self.entry] = True
        open_ = points >= 0
        live = np.arange(n)
        while len(live):
            first = open_[live].argmax(axis=1)
            open_[live, first] = False
            fresh = self.out[points[live, first]]
            fresh = np.where((fresh >= 0) & ~seen[live[:, None], np.maximum(fresh, 0)], fresh, -1)
            rows, cols = np.nonzero(fresh >= 0)
            seen[live[rows], fresh[rows, cols]] = True
            d = self.distances(queries[live], fresh)
            all_near = np.concatenate([near[live], d], axis=1)
            best = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            points[live] = np.take_along_axis(np.concatenate([points[live], fresh], axis=1), best, axis=1)
            near[live] = np.take_along_axis(all_near, best, axis=1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh >= 0], axis=1), best, axis=1) & (points[live] >= 0)
            live = live[open_[live].any(axis=1)]
        return points, near

    def prune(self, point: int, pool: np.ndarray) -> np.ndarray:
        """Relaxed distance pruning: the nearest stays, and drops what lies ALPHA times nearer to it than to the point."""
        pool = np.unique(pool[(pool >= 0) & (pool != point)])
        x = self.x[pool]
        to_point = ((x - self.x[point]) ** 2).sum(axis=1)
        order = np.argsort(to_point, kind="stable")
        pool, x, to_point = pool[order], x[order], to_point[order]
        between = self.square[pool][:, None] + self.square[pool][None, :] - 2 * x @ x.T
        hidden = self.alpha**2 * between <= to_point[None, :]
        kept, left = [], np.ones(len(pool), dtype=bool)
        for i in range(len(pool)):
            if left[i]:
                kept.append(i)
                if len(kept) == self.degree:
                    break
                left &= ~hidden[i]
        return pool[kept]

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        points, _ = self.search(self.x[batch], beam)
        # Rows of one batch can't find each other yet: the nearest of them are proposed too.
        among = self.square[batch][None, :] - 2 * self.x[batch] @ self.x[batch].T
        beside = batch[np.argsort(among, axis=1, kind="stable")[:, : min(16, len(batch))]]
        back: dict[int, list[int]] = {}
        for row, point in enumerate(batch.tolist()):
            kept = self.prune(point, np.concatenate([points[row], beside[row]]))
            self.out[point, : len(kept)] = kept
            for k in kept.tolist():
                back.setdefault(k, []).append(point)
        for k, sources in back.items():
            own = self.out[k][self.out[k] >= 0]
            joined = np.unique(np.concatenate([own, sources]))
            if len(joined) > self.out.shape[1]:
                joined = self.prune(k, joined)
            self.out[k] = -1
            self.out[k, : len(joined)] = joined


class Shard:
    """The graphs of a shard's distinct vectors, one for each length, and the ids of each node."""

    def __init__(self, table: pa.Table) -> None:
        self.graphs: dict[int, tuple[Graph, np.ndarray, np.ndarray]] = {}
        lengths = _lengths(table)
        for length in np.unique(lengths).tolist():
            rows = table.filter(pa.array(lengths == length))
            distinct, node = np.unique(matrix(rows.column("vector")), axis=0, return_inverse=True)
            ids = rows.column("id").to_numpy()
            order = np.lexsort((ids, node.ravel()))
            self.graphs[length] = Graph(distinct), ids[order], np.searchsorted(node.ravel()[order], np.arange(len(distinct) + 1))

    def answer(self, queries: pa.Table, k: int) -> Iterator[pa.Table]:
        """(query_id, vec_id, score): the k nearest ids found to each query, each id by its nearest vector."""
        lengths = _lengths(queries)
        for length in np.unique(lengths).tolist():
            if length not in self.graphs:
                continue
            graph, ids, bounds = self.graphs[length]
            asked = queries.filter(pa.array(lengths == length))
            q, query_ids = matrix(asked.column("vector")), asked.column("id").to_numpy()
            for at in range(0, len(q), QUERY_BLOCK):
                parts = []
                points, _ = graph.search(q[at : at + QUERY_BLOCK], min(SEARCH_BEAM, len(graph.x)))
                for row, own in enumerate(points, at):
                    own = own[own >= 0]
                    exact = np.sqrt(((graph.x[own] - q[row]) ** 2).sum(axis=1))
                    # All rows of a node are as near: of each, more than k different ids are never needed.
                    found = [np.unique(ids[bounds[p] : bounds[p + 1]])[: k + 1] for p in own]
                    vec, score = np.concatenate(found), np.repeat(exact, [len(f) for f in found])
                    order = np.lexsort((vec, score))
                    vec, score = vec[order], score[order]
                    first = np.sort(np.unique(vec, return_index=True)[1])
                    first = first[vec[first] != query_ids[row]][:k]
                    parts.append((np.full(len(first), query_ids[row]), vec[first], score[first]))
                yield pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=ANSWERS)


ANSWERS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _lengths(table: pa.Table) -> np.ndarray:
    return pc.list_value_length(table.column("vector")).to_numpy().astype(np.int64)


def _answered(k: int):
    """Over rows sorted by (shard, asked): a shard's vectors come first, then all queries, as a stream."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, built = None, [], None
        for batch in batches:
            of, asked = batch.column("shard").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((of[1:] != of[:-1]) | (asked[1:] != asked[:-1])) + 1
            for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                if of[low] != shard:
                    shard, rows, built = of[low], [], None
                part = pa.Table.from_batches([batch.slice(low, high - low)])
                if not asked[low]:
                    rows.append(part)
                elif rows or built:
                    built = built or Shard(pa.concat_tables(rows))
                    rows = []
                    for table in built.answer(part, k):
                        yield from table.to_batches()

    return answered


def nearest(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row for which ``is_query`` holds, by Euclidean distance."""
    marked = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asked")).filter("id IS NOT NULL")
    rows = cut(usable_rows(marked, "id", "vector"), "ann-vectors")
    wanted = marked.filter("asked").select("id").distinct()
    queries = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    # Rows of equal vectors are dealt by their ids as well, and rows of one id by their vectors: no shard gets all.
    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"))
    asked = queries.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"))
    placed = dealt.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "asked")
    found = placed.mapInArrow(_answered(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
