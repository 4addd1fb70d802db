"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are read in blocks of bounded size.  A block holds, for each dimension,
the order of its vectors by that component.  A query walks all lists from the end
that its own sign prefers; a vector that turns up in any list is scored in full
(random access), and at each depth the bound is the score of a vector that would
stand at that depth in all lists.  Once the k-th best score is above the bound, no
unseen vector can reach it and the block is done for that query; ties go to the
smaller id, so the comparison is strict.  The k-th best score is carried from block
to block, so a later block may be done before its first entry.  A query that has seen
half of a block scores the rest of it at once: reading on would cost more than that.

Rows and queries meet in the cells of a grid of row strips and query strips.  A
query strip fits a task's memory, a row strip streams past it block by block, and
the number of cells follows from the query strips and the session's parallelism, not
from the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism

BLOCK_ROWS = 4096
#: Queries of one strip, about.
STRIP_QUERIES = 4096
#: Cells for each of the session's shuffle partitions, at most, where one query strip is enough.
CELLS = 2
FIRST_DEPTH = 8
#: Queries that score whole blocks together.
STEP_QUERIES = 256
_EXACT = float(1 << 53)


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, taken as a double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str) -> Column:
    """True for vectors that aren't null, hold no null and only finite components."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


class Best:
    """The k best candidates so far of each query of a strip."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = ids, queries, k
        self.ids = [np.zeros(0, np.int64)] * len(ids)
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        #: k-th best score, below every score while there are fewer.
        self.floor = np.full(len(ids), -np.inf)
        #: rows that were scored for a query, all queries together
        self.scored = 0

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes scored rows of query i into account."""
        self.scored += len(ids)
        kept = (scores >= self.floor[i]) & (ids != self.own[i])
        if not kept.any():
            return
        ids, scores = ids[kept], scores[kept]
        if len(scores) > self.k:  # nothing below the k-th best of these
            kept = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[kept], scores[kept]
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores.astype(np.int64)])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[i] = self.scores[i][-1]

    def search(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """The threshold algorithm on one block of rows, for all queries."""
        n, dims = rows.shape
        queries = self.queries
        if dims * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) < _EXACT:
            rows, queries = rows.astype(np.float64), queries.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        lists = np.take_along_axis(rows, order, axis=0)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        # nothing is read where not even the heads of all lists together reach the k-th best
        open_ = np.flatnonzero(up @ lists[-1] + down @ lists[0] >= self.floor)
        seen = np.zeros((len(open_), n), bool)
        at, depth, before, rest = np.arange(len(open_)), min(FIRST_DEPTH, n), 0, []
        while len(at):
            bound = up[open_[at]] @ lists[n - depth] + down[open_[at]] @ lists[depth - 1]
            left = []
            for j, b in zip(at.tolist(), bound.tolist()):
                i = int(open_[j])
                q = queries[i]
                read = np.concatenate([order[n - depth : n - before, q > 0].ravel(), order[before:depth, q < 0].ravel()])
                fresh = np.zeros(n, bool)
                fresh[read] = True
                fresh &= ~seen[j]
                if depth == n or 2 * (int(seen[j].sum()) + int(fresh.sum())) > n:
                    rest.append(j)  # scores all that isn't scored yet, below
                    continue
                seen[j] |= fresh
                found = np.flatnonzero(fresh)
                self.add(i, ids[found], rows[found] @ q)
                if not self.floor[i] > b:
                    left.append(j)
            at, before, depth = np.array(left, dtype=int), depth, min(2 * depth, n)
        for begin in range(0, len(rest), STEP_QUERIES):
            part = np.array(rest[begin : begin + STEP_QUERIES])
            scores = queries[open_[part]] @ rows.T
            for j, own in zip(part.tolist(), scores):
                unseen = np.flatnonzero(~seen[j])
                self.add(int(open_[j]), ids[unseen], own[unseen])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, strip_queries: int = STRIP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, from rank 1; ties to the smaller id.

    Both inputs hold id_col and vector_col.  Rows with a null id, a null vector
    or a null or non-finite component take no part; a query meets only vectors
    of its own length and none with its own id; repeated candidates count as
    often as they stand there, and queries that repeat an id are answered
    together.  Empty inputs give no rows.  Components must fit
    64-bit integers once scaled, and so must the scores.
    """
    take = lambda df: df.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), quantised(vector_col).alias("v")).filter(F.size("v") > 0)
    rows, asked = take(candidates), take(queries)
    # counts of rows only: how fine the grid is to be
    n, m = rows.count(), asked.count()
    across = max(1, -(-m // strip_queries))
    down = max(1, min(-(-n // block_rows), -(-CELLS * parallelism(candidates.sparkSession) // across)))
    strip = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = rows.select("id", "v", strip(down).alias("down"), every(across).alias("across"), F.lit(1).alias("kind"))
    theirs = asked.select("id", "v", every(down).alias("down"), strip(across).alias("across"), F.lit(0).alias("kind"))
    cells = mine.unionByName(theirs).select((F.col("down") * across + F.col("across")).alias("cell"), F.size("v").alias("dims"), "kind", "id", "v")
    cells = cells.repartition(down * across, "cell").sortWithinPartitions("cell", "dims", "kind")

    def search(batches):
        cell, best, asked, held, size = None, None, [], [], 0

        def block():
            nonlocal best, asked, held, size
            if asked:
                best, asked = Best(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), k), []
            if held and best is not None:
                ids, vectors = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                for begin in range(0, len(ids), block_rows):
                    best.search(ids[begin : begin + block_rows], vectors[begin : begin + block_rows])
            held, size = [], 0

        def answer():
            block()
            if best is not None:
                many = [len(i) for i in best.ids]
                if sum(many):
                    yield pd.DataFrame({"query_id": np.repeat(best.own, many), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})

        for pdf in batches:
            for key, part in pdf.groupby(["cell", "dims", "kind"], sort=False):
                if key[:2] != cell:
                    yield from answer()
                    cell, best = key[:2], None
                some = part["id"].to_numpy(), np.stack([np.asarray(v, np.int64) for v in part["v"]])
                if key[2]:
                    held.append(some)
                    size += len(part)
                    if size >= block_rows:
                        block()
                else:
                    asked.append(some)
        yield from answer()

    found = cells.mapInPandas(search, "query_id long, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
