"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into blocks. A block keeps one sorted list per dimension, and
a query reads all lists from their best end in step, deeper from round to round.
A candidate's score lies between what was read plus the least, and plus the most, that the
unread entries can give: the most is each list's present depth, the least its end. A
candidate leaves when ``k`` others have lower bounds above its upper bound; when
no outsider can qualify any more, the few left have their scores resolved.
Blocks give ``k`` rows a query at most, and these are merged.

Queries and candidates meet as blocks in a grid: each cell is a task's work of bounded size,
and neither side is ever gathered or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.workspace import materialize

SCALE = 1024
K = 10
BLOCK = 4096
QUERIES = 512
#: Parts of the lists that are read by the end of each round; whoever is left then has its score resolved.
DEPTHS = (0.25, 0.5, 0.75)

RESULT = "query_id long, query_key long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component; vectors with a null or non-finite one are left out."""
    fine = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"
    return vectors.where(f"vec_id IS NOT NULL AND forall(embedding, x -> {fine})").selectExpr(
        "CAST(vec_id AS LONG) AS vec_id", f"transform(embedding, x -> floor({scale}D * CAST(x AS DOUBLE))) AS v"
    )


class Lists:
    """A block's candidates and their sorted list in every dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.sorted = np.sort(self.values, axis=0)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's ``k`` best, equal scores by smaller id.

        A query reads the list of a positive component from the top and that of a negative one
        from the bottom. All queries of a cell read to the same depth, so their bounds
        are matrix products over the values read, with the depth's or the end's value for those that weren't.
        """
        n, values = len(self.ids), self.values
        mine = own[:, None] == self.ids[None, :]
        left = ~mine
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        for part in DEPTHS if n > 2 * k else ():
            depth = max(1, int(n * part))
            top, bottom = self.sorted[n - depth], self.sorted[depth - 1]
            high = up @ np.maximum(values, top).T + down @ np.minimum(values, bottom).T
            low = up @ np.where(values >= top, values, self.sorted[0]).T
            low += down @ np.where(values <= bottom, values, self.sorted[-1]).T
            low[mine] = low.min()
            kth = np.partition(low, n - k, axis=1)[:, n - k]
            left &= high >= kth[:, None]
            if left.sum(axis=1).max() <= 4 * k:
                break
        found = []
        for query, use in zip(queries, left):
            at = np.flatnonzero(use)
            scores = values[at] @ query
            if len(at) > k:
                few = scores >= np.partition(scores, len(at) - k)[len(at) - k]
                at, scores = at[few], scores[few]
            order = np.lexsort((self.ids[at], -scores))[:k]
            found.append((self.ids[at][order], scores[order]))
        return found


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table["v"].combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return table["vec_id"].to_numpy(), flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _exact(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Types in which all sums are exact: doubles (fast), 64-bit integers, or Python's integers."""
    top = (int(np.abs(c).max(initial=0)) + 1) * (int(np.abs(q).max(initial=0)) + 1) * (c.shape[1] + 1)
    kind = np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object
    return c.astype(kind), q.astype(kind)


def _cell(k: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, c), (q_ids, q) = _matrix(left), _matrix(right)
        keys = right["query_key"].to_numpy()
        rows = []
        if len(ids) and len(q_ids):
            c, q = _exact(c, q)
            lists = Lists(ids, c)
            for own, key, (found, scores) in zip(q_ids.tolist(), keys.tolist(), lists.best(q, q_ids, k)):
                rows.append((np.full(len(found), own), np.full(len(found), key), found, scores))
        columns = [np.concatenate([r[i] for r in rows]) if rows else [] for i in range(4)]
        top = (1 << 63) - 1
        columns[3] = [max(-top - 1, min(top, int(s))) for s in columns[3]]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "query_key", "vec_id", "score"])

    return cell


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with all rows of other ids.

    Both tables have ``vec_id, embedding``. Vectors that are null, or hold null or
    non-finite components, and null ids take no part. Only vectors of equal length meet.
    Equal scores go to the smaller ``vec_id``; repeated candidates are ranked each, repeated queries
    answered once. Scores beyond 64 bits are clipped. Empty tables give an empty result; other columns are ignored.
    """
    found = materialize(scaled(vectors, scale).selectExpr("*", "size(v) AS dims"), "vectors")
    asked = materialize(scaled(queries, scale).distinct().selectExpr("*", "size(v) AS dims", "xxhash64(v) AS query_key"), "queries")
    n_blocks = -(-found.count() // BLOCK) or 1
    n_sets = -(-asked.count() // QUERIES) or 1
    grid = ["dims", "block", "part"]
    c = found.selectExpr(
        "vec_id", "v", "dims", f"CAST(pmod(xxhash64(vec_id), {n_blocks}) AS INT) AS block",
        f"explode(sequence(0, {n_sets - 1})) AS part",
    )
    q = asked.selectExpr(
        "vec_id", "v", "query_key", "dims", f"explode(sequence(0, {n_blocks - 1})) AS block",
        f"CAST(pmod(xxhash64(vec_id, 1), {n_sets}) AS INT) AS part",
    )
    best = c.groupBy(*grid).cogroup(q.groupBy(*grid)).applyInArrow(_cell(k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
