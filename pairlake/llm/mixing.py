"""Mixing sources to target weights: hierarchical budgeting over a tree such as domain, language, source.

Weights are relative among siblings and go down the tree. A leaf can give at most its tokens times
``max_epochs``, and a node what its weighted children can; what it lacks goes to its siblings by their
weights, only what a whole family lacks goes back to the siblings of its parent, and what is left when all
weighted leaves are used up to leaves without weight. Each leaf then reads its documents epoch by epoch, each
epoch in a seeded order of its own, and takes the prefix that its budget of tokens allows; the
document that crosses the end is taken in part.

The tree has a row for each leaf, that is for each source, and is budgeted on the driver; its size
follows the number of sources, not of documents. Prefix sums don't bring a leaf together: hash ranges
of its order are summed first, and only the range in which a budget ends is ordered.

Null token counts are 0; documents without tokens are in no prefix. A null level is a source of its
own. Rows with one doc_id share their place in the order and are taken each. Empty tables select
nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of one hash range, about.
PER_RANGE = 20_000

Weights = Mapping[tuple, float]


def budgets(leaves: Mapping[tuple, int], weights: Weights, total: int, max_epochs: int = 1, unnamed: float = 0) -> dict[tuple, int]:
    """Tokens to take from each leaf (path -> tokens it has).

    weights: path of a node -> its weight among its siblings. Siblings that aren't named (null is one) share
    what all named weights of the family leave of 1, and no less than unnamed, by the tokens they have; whether
    a named sibling is there doesn't matter. Leaves under a weight of 0 only take what no others can.
    """
    have: dict[tuple, int] = {}
    below: dict[tuple, set] = {}
    for leaf, n in leaves.items():
        for i in range(len(leaf) + 1):
            have[leaf[:i]] = have.get(leaf[:i], 0) + n
            if i:
                below.setdefault(leaf[: i - 1], set()).add(leaf[:i])
    out: dict[tuple, int] = {}

    shares: dict[tuple, dict] = {}
    sure: dict[tuple, int] = {}
    for node in sorted(have, key=len, reverse=True):  # children first
        if node not in below:
            sure[node] = have[node] * max_epochs
            continue
        family = sorted(below[node], key=repr)
        named = {c: Fraction(str(weights[c])) for c in family if c in weights}
        rest = sum(have[c] for c in family if c not in named)
        left = max(Fraction(str(unnamed)), 1 - sum(Fraction(str(w)) for c, w in weights.items() if c[:-1] == node and c))
        shares[node] = {c: named[c] if c in named else left * have[c] / rest if rest else Fraction(0) for c in family}
        sure[node] = sum(sure[c] for c in family if shares[node][c] > 0)

    def filled(budget: int, share: dict, room: dict) -> dict:
        """The budget by share, no child beyond its room."""
        todo = sorted((c for c in share if share[c] > 0), key=lambda c: room[c] / share[c])  # the short ones first
        weight, got = sum(share[c] for c in todo), dict.fromkeys(share, 0)
        for c in todo:
            got[c] = min(room[c], budget if c == todo[-1] else int(budget * share[c] / weight))
            budget, weight = budget - got[c], weight - share[c]
        for c in todo:  # what whole numbers left over
            more = min(room[c] - got[c], budget)
            got[c], budget = got[c] + more, budget - more
        return got

    def give(node: tuple, budget: int) -> None:
        if node not in below:
            out[node] = budget
            return
        first = min(budget, sure[node])
        got = filled(first, shares[node], sure)
        if budget > first:  # only when all weighted leaves are used up
            more = {c: Fraction(have[c] * max_epochs - got[c]) for c in got}
            got = {c: got[c] + n for c, n in filled(budget - first, more, {c: int(n) for c, n in more.items()}).items()}
        for c, n in got.items():
            give(c, n)

    give((), min(total, have.get((), 0) * max_epochs))
    return out


def mixed(docs: DataFrame, levels: Mapping[str, Column], tokens: Column, weights: Weights, total: int | float, max_epochs: int = 1, seed: int = 0, unnamed: float = 0) -> DataFrame:
    """doc_id, the levels, epoch (from 0), tokens_taken; total: tokens, or a share of all as a float."""
    given, levels = list(levels), {f"level_{i}": c for i, c in enumerate(levels.values())}  # whatever they are called
    names = list(levels)
    n = F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("string").alias(k) for k, c in levels.items()), n.alias("n"))
    rows = written(rows, "tokens").where("n > 0")  # a filter before would count every text's tokens once more
    leaves = rows.groupBy(*names).agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()  # a row for each source
    have = {tuple(r[k] for k in names): r["n"] for r in leaves}
    want = int(Fraction(str(total)) * sum(have.values())) if isinstance(total, float) else total
    plan = budgets(have, weights, want, max_epochs, unnamed)
    parts = [(*leaf, epoch, min(have[leaf], b - epoch * have[leaf])) for leaf, b in plan.items() for epoch in range(-(-b // have[leaf]) if b else 0)]
    spark = docs.sparkSession
    schema = ", ".join(f"{k} string" for k in [f"leaf_{x}" for x in names]) + ", epoch int, budget long"
    goal = spark.createDataFrame(parts, schema)
    bits = max(0, (max((r["docs"] for r in leaves), default=1) // PER_RANGE).bit_length())
    on = [F.col(k).eqNullSafe(F.col(f"leaf_{k}")) for k in names]
    dealt = rows.join(goal, on).drop(*(f"leaf_{k}" for k in names))
    dealt = dealt.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id")).withColumn("range", F.shiftright("h", 63 - bits))
    key = [*names, "epoch"]
    sums = dealt.groupBy(*key, "range").agg(F.sum("n").alias("sum"), F.first("budget").alias("budget"))
    before = F.sum("sum").over(Window.partitionBy(*key).orderBy("range")) - F.col("sum")
    sums = sums.withColumn("before", before).where("before < budget").drop("budget")
    sums = sums.select(*(F.col(k).alias(f"of_{k}") for k in [*key, "range"]), "sum", "before")
    near = dealt.join(sums, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*key, "range"]])
    whole = near.where("before + sum <= budget").select("doc_id", *key, F.col("n").alias("tokens_taken"))
    inside = Window.partitionBy(*key, "range").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    last = near.where("before + sum > budget").withColumn("before", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    last = last.where("before < budget").select("doc_id", *key, F.least("n", F.col("budget") - F.col("before")).alias("tokens_taken"))
    return whole.union(last).withColumnsRenamed(dict(zip(names, given)))


def resampled(docs: DataFrame, levels: Mapping[str, Column], tokens: Column, weights: Weights, total: int | float, max_epochs: int = 1, seed: int = 0, unnamed: float = 0) -> DataFrame:
    """The rows of docs that are selected, whole, once for each epoch; rows with a null doc_id aren't."""
    chosen = mixed(docs, levels, tokens, weights, total, max_epochs, seed, unnamed).where("doc_id is not null")
    chosen = chosen.select(F.col("doc_id").alias("pairlake_of"), "epoch").distinct()
    return docs.join(chosen, docs["doc_id"].cast("long") == chosen["pairlake_of"]).select(*(docs[c] for c in docs.columns))
