"""Hard negatives: every anchor's whole list of scores is sorted, and limits are found in it by binary search.

Vectors become integers floor(scale * x), so scores (inner products) are exact. Anchors fall to groups by
hash, all rows to blocks; a task gets one group and one block, whatever the number of rows. Within it
every anchor's scores of the whole block are sorted by score (higher first) and id.

1. Positives: an anchor meets the blocks of its own label only. The first ``positives`` of each block's
   order are merged to those of all rows.
2. Negatives: an anchor meets all blocks. Each of its positives has an upper limit, found by binary search
   in the order; from there the first ``k`` rows of another label are read, down to the lower limit. The
   first ``k`` of all blocks are the answer, as no block holds more of them than it returned.

Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part. Rows
score only with vectors of their own length. Rows that repeat the anchor's id are its own: neither positives nor
negatives; one of them is the anchor, the first by label (as text) and vector. Repeated rows of other ids are
rows each: a repeated positive has a list each time. An anchor without positives, or a positive
without negatives between its limits, gives no rows; so does an empty table. A score beyond 64 bits is an error.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk import _matrix as matrix
from .topk import dot

SCALE, POSITIVES, K, LOW, HIGH = 256, 5, 10, 30, 90
#: Components of a block of rows and of a group of anchors (about); scores that stand in a task at once.
BLOCK, GROUP, SCORES = 1 << 19, 1 << 17, 1 << 21


def _orders(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor's place, ids, scores, whether the label is the anchor's) of the block's other rows, by score and id."""
    ids, x, q = rows["vec_id"].to_numpy(), matrix(rows["v"], len(rows)), matrix(anchors["v"], len(anchors))
    own = anchors["vec_id"].to_numpy()
    labels = np.unique(np.concatenate([rows["label"].to_numpy(), anchors["label"].to_numpy()]).astype(str), return_inverse=True)[1]
    of_rows, of_anchors = labels[: len(ids)], labels[len(ids) :]
    step = max(1, SCORES // len(ids))
    for at in range(0, len(own), step):
        for i, s in enumerate(dot(q[at : at + step], x), at):
            order = np.lexsort((ids, -s))
            order = order[ids[order] != own[i]]
            yield i, ids[order], s[order], of_rows[order] == of_anchors[i]


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest whole score between low and high percent of a positive's score."""
    return -(-low * score // 100), high * score // 100


def between(scores: np.ndarray, other: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """The first k places, among those in ``other``, whose score (falling) is from least to most."""
    start, end = np.searchsorted(-scores, -most, "left"), np.searchsorted(-scores, -least, "right")
    at = np.searchsorted(other, start)
    found = other[at : at + k]
    return found[found < end]


def _blocks(rows: DataFrame, anchors: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors of each unit: (key, g, block); anchors of a key meet all rows of that key."""
    bound = lambda n, most: F.greatest(F.ceil(n * F.col("size") / most), F.lit(1)).cast("int")
    groups = anchors.groupBy(*key).agg(F.count("*").alias("n_anchors")).select(*key, bound(F.col("n_anchors"), GROUP).alias("groups"))
    parts = rows.groupBy(*key).agg(F.count("*").alias("n_rows")).select(*key, bound(F.col("n_rows"), BLOCK).alias("blocks"))
    parts = written(parts.join(groups, list(key)), "parts")
    cut = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.join(parts, list(key)).withColumn("block", cut("blocks")).withColumn("g", each("groups"))
    asked = anchors.join(parts, list(key)).withColumn("g", cut("groups")).withColumn("block", each("blocks"))
    return data.drop("groups", "blocks").groupBy(*key, "g", "block"), asked.drop("groups", "blocks").groupBy(*key, "g", "block")


def _table(columns: list[list], schema: str) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_rank, positive_id, positive_score: the best other rows of an anchor's label."""
    schema = "anchor_id long, positive_id long, positive_score long"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            own = right["vec_id"].to_pylist()
            for i, ids, scores, _ in _orders(left, right):
                out[0] += [own[i]] * len(ids[:n])
                out[1] += ids[:n].tolist()
                out[2] += [int(s) for s in scores[:n]]
        return _table(out, schema)

    data, asked = _blocks(rows.select("size", "label", "vec_id", "v"), anchors, "size", "label")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = data.cogroup(asked).applyInArrow(best, schema)
    return found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= n)


NEGATIVES = "anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, n: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    vectors: vec_id, embedding, label; label: another expression of its columns. low and high: percent of a positive's score.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = (F.col("label") if label is None else label).cast("string")
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(scale * x).cast("double")).alias("v"), is_anchor.alias("asks"))
    rows = written(rows.withColumn("size", F.size("v")), "vectors")
    anchors = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v", "size")).alias("a")).select("vec_id", "a.label", "a.v", "a.size")
    anchors = written(anchors, "anchors")
    own = written(positives(rows, anchors, n), "positives")
    limits = own.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("p"))  # n at most

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if len(left) and len(right):
            anchor, wanted = right["vec_id"].to_pylist(), right["p"].to_pylist()
            for i, ids, scores, same in _orders(left, right):
                other = np.flatnonzero(~same)
                for p in wanted[i]:
                    found = between(scores, other, *_limits(p["positive_score"], low, high), k)
                    for column, value in zip(out, (anchor[i], p["positive_rank"], p["positive_id"], p["positive_score"])):
                        column += [value] * len(found)
                    out[4] += ids[found].tolist()
                    out[5] += [int(s) for s in scores[found]]
        return _table(out, NEGATIVES)

    data, asked = _blocks(rows.select("size", "label", "vec_id", "v"), anchors.join(limits, "vec_id"), "size")
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.col("negative_score").desc(), "negative_id")
    found = data.cogroup(asked).applyInArrow(read, NEGATIVES).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))
