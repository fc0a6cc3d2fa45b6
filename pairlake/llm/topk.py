"""Exact top-k by inner product: dual-tree search with cover trees.

Vectors become integers floor(scale * x), so scores are exact. Rows fall to blocks by their nearest
pivot (a sample, by hash, of about the square root of the rows, MOST_PIVOTS at most), large blocks are
split by hash; queries fall to groups in the same way. A task gets one group of queries and one block of
rows, builds a cover tree over each, and descends both together: a pair of nodes with covering radii r
and s and centres a and b scores at most a.b + r|b| + s|a| + r s, and is pruned if that is below the
worst kth score in the query group. First each group meets one block of its own pivot; the kth scores
found there and the same bound, with pivots as centres, prune whole blocks before any row is sent, and
then nodes within the others.

Vectors that are null or hold null, NaN or infinite components, and rows with a null vec_id, take no
part. A score needs equal lengths: vectors of another length aren't candidates. Rows that repeat a
query's vec_id are its own; if their vectors differ they are one query, whose scores are those of all.
Repeated rows of other ids are candidates each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K = 1024, 10
MOST_PIVOTS, BLOCK, GROUP, LEAF, BASE = 256, 4096, 2048, 48, 1.3


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


class Node:
    """Rows within ``radius`` of a centre; children cover them, or it is a leaf."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.rows, self.children = rows, []
        self.center = x[rows[0]]
        self.norm = float(np.linalg.norm(self.center))
        away = np.linalg.norm(x[rows] - self.center, axis=1)
        self.radius = float(away.max())
        if len(rows) <= LEAF or self.radius == 0:
            return
        step, rest, few = self.radius / BASE, rows, []
        parts = []
        while len(rest):
            near = np.linalg.norm(x[rest] - x[rest[0]], axis=1) <= step
            part, rest = rest[near], rest[~near]
            (few if len(part) < LEAF // 4 else parts).append(part)
        if few:  # rows far from each other share leaves; their radius is measured, so bounds hold
            few = np.concatenate(few)
            parts += [few[i : i + LEAF] for i in range(0, len(few), LEAF)]
        self.children = [Node(x, p) for p in parts]


class Search:
    """The k best rows of each query so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, least: np.ndarray, k: int):
        self.q, self.q_ids, self.x, self.x_ids, self.k = queries, query_ids, rows, row_ids, k
        self.worst = least.astype(np.float64)
        self.scores: list[np.ndarray] = [np.empty(0, object)] * len(queries)
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)

    def bound(self, q: Node, r: Node) -> float:
        top = float(q.center @ r.center) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return top + 1e-9 * abs(top) + 1e-6

    def run(self) -> None:
        if len(self.q) and len(self.x):
            self.pair(Node(self.q, np.arange(len(self.q))), Node(self.x, np.arange(len(self.x))))

    def pair(self, q: Node, r: Node) -> None:
        if self.bound(q, r) < self.worst[q.rows].min():
            return
        if not q.children and not r.children:
            self.leaves(q.rows, r.rows)
        elif q.children and (not r.children or q.radius > r.radius):
            for c in q.children:
                self.pair(c, r)
        else:
            for _, _, c in sorted((-self.bound(q, c), i, c) for i, c in enumerate(r.children)):
                self.pair(q, c)

    def leaves(self, q: np.ndarray, r: np.ndarray) -> None:
        for at in range(0, len(r), BLOCK):
            rows = r[at : at + BLOCK]
            scores, ids = dot(self.q[q], self.x[rows]), self.x_ids[rows]
            good = (scores >= self.worst[q][:, None]) & (ids[None, :] != self.q_ids[q][:, None])
            for i in np.flatnonzero(good.any(1)):
                s, n, who = np.concatenate([self.scores[q[i]], scores[i][good[i]]]), np.concatenate([self.ids[q[i]], ids[good[i]]]), q[i]
                best = np.lexsort((n, -s))[: self.k]
                self.scores[who], self.ids[who] = s[best], n[best]
                if len(best) == self.k:
                    self.worst[who] = max(self.worst[who], float(s[best[-1]]))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, np.float64).reshape(n, -1)


FOUND = "query_id long, vec_id long, score long"


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best rows of each (g, block), from rows (g, block, vec_id, v) and queries (g, block, vec_id, v, least)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            found = Search(_matrix(right["w"], len(right)), right["query_id"].to_numpy(), _matrix(left["v"], len(left)), left["vec_id"].to_numpy(), right["least"].to_numpy(), k)
            found.run()
            for q, ids, scores in zip(found.q_ids.tolist(), found.ids, found.scores):
                out[0] += [q] * len(ids)
                out[1] += ids.tolist()
                out[2] += [int(s) for s in scores]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    queries = queries.toDF("for_g", "for_block", "query_id", "w", "least")
    return rows.groupBy("g", "block").cogroup(queries.groupBy("for_g", "for_block")).applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows other than itself."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(scale * x).cast("double")).alias("v"), is_query.alias("q"))
    n = rows.count()
    few = min(MOST_PIVOTS, max(1, int(n**0.5)))
    sample = rows.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(few).select("v").collect()  # MOST_PIVOTS rows at most
    pivots = [np.array(r["v"]) for r in sample]

    @F.pandas_udf("pivot int, away double")
    def nearest(values):
        import pandas as pd

        out, away = np.zeros(len(values), np.int32), np.full(len(values), np.inf)
        sizes = np.array([len(x) for x in values])
        for m in np.unique(sizes):
            own = np.flatnonzero(sizes == m)
            same = [i for i, p in enumerate(pivots) if len(p) == m]
            if not same:
                continue
            x, p = np.array([values.iloc[i] for i in own], float).reshape(len(own), m), np.stack([pivots[i] for i in same])
            for at in range(0, len(own), 1024):
                part = x[at : at + 1024]
                d = (part**2).sum(1)[:, None] - 2 * part @ p.T + (p**2).sum(1)
                best = d.argmin(1)
                out[own[at : at + 1024]] = np.array(same, np.int32)[best]
                away[own[at : at + 1024]] = np.linalg.norm(part - p[best], axis=1)
        return pd.DataFrame({"pivot": out, "away": away})

    placed = written(rows.withColumn("size", F.size("v")).withColumn("near", nearest("v")).select("vec_id", "v", "q", "size", "near.pivot", "near.away"), "vectors")
    splits = lambda c, most, name: F.greatest(F.ceil(c / most), F.lit(1)).cast("int").alias(name)
    parts = written(placed.groupBy("size", "pivot").agg(splits(F.count("*"), BLOCK, "blocks"), splits(F.count_if("q"), GROUP, "groups")), "parts")
    cut = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    data = placed.join(parts, ["size", "pivot"]).select("size", "pivot", "vec_id", "v", "away", cut("blocks").alias("k"), "blocks")
    asked = placed.where("q").dropDuplicates(["vec_id", "v"]).join(parts, ["size", "pivot"]).select("size", "pivot", "vec_id", "v", "away", cut("groups").alias("k"), "blocks")
    block = F.struct("size", "pivot", "k")
    lowest = F.lit(float("-inf"))
    home = F.pmod("k", F.col("blocks")).cast("int")  # of a group: the block it meets first

    near = asked.select(block.alias("g"), F.struct("size", "pivot", home.alias("k")).alias("block"), "vec_id", "v", lowest.alias("least"))
    pairs = near.select("g", "block").distinct()
    first = written(_searched(_sent(data, pairs), near, k), "near")
    least = _kth(first, k)

    # which blocks a group still has to meet: by pivots, radii and the group's worst kth score
    asked = asked.join(least, asked["vec_id"] == least["query_id"], "left").select("size", "pivot", "vec_id", "v", "away", "k", "blocks", F.coalesce(F.col("least").cast("double"), lowest).alias("least"))
    asked = written(asked, "asked")
    ball = lambda df: df.groupBy("size", "pivot", "k")
    groups = ball(asked).agg(F.max("away").alias("r"), F.min("least").alias("least"), F.first("blocks").alias("blocks"))
    blocks = ball(data).agg(F.max("away").alias("s")).select(F.col("size").alias("b_size"), F.col("pivot").alias("b_pivot"), F.col("k").alias("b_k"), "s")
    table = [(i, j, float(p @ q), float(np.linalg.norm(p)), float(np.linalg.norm(q))) for i, p in enumerate(pivots) for j, q in enumerate(pivots) if len(p) == len(q)]
    products = F.broadcast(rows.sparkSession.createDataFrame(table, "pivot int, b_pivot int, dot double, p double, q double"))  # MOST_PIVOTS squared at most
    top = F.col("dot") + F.col("r") * F.col("q") + F.col("s") * F.col("p") + F.col("r") * F.col("s")
    met = groups.join(products, "pivot").join(blocks, "b_pivot").where("size = b_size").where(~(top + F.abs(top) * 1e-6 + 1e-3 < F.col("least")))  # vectors that no pivot has the length of are at no distance: met
    own = (F.col("pivot") == F.col("b_pivot")) & (F.col("b_k") == home)
    met = met.where(~own).select(block.alias("g"), F.struct(F.col("b_size").alias("size"), F.col("b_pivot").alias("pivot"), F.col("b_k").alias("k")).alias("block"))
    # balls share groups of about GROUP queries, so that a block is sent few times; a ball isn't sent to its home again
    many = max(1, -(-placed.where("q").count() // GROUP))
    shared = lambda size, pivot, number: F.struct(size.alias("size"), F.floor(pivot * many / few).cast("int").alias("pivot"), number.alias("k"))
    met = written(met.select(shared(F.col("g.size"), F.col("g.pivot"), F.col("g.k")).alias("g"), "block").distinct(), "met")
    sent = asked.withColumn("own", F.struct("size", "pivot", home.alias("k"))).withColumn("g", shared(F.col("size"), F.col("pivot"), F.col("k")))
    rest = _searched(_sent(data, met), sent.join(met, "g").where(F.col("block") != F.col("own")).select("g", "block", "vec_id", "v", "least"), k)
    return _ranked(first.union(rest), k)


def _sent(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of each (g, block) of pairs."""
    return data.withColumn("block", F.struct("size", "pivot", "k")).select("block", "vec_id", "v").join(pairs, "block").select("g", "block", "vec_id", "v")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A query has k rows from each block at most, fewer beyond its first ones."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """query_id, least: the kth best score, for queries that have k."""
    return _ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
