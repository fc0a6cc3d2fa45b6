"""Positions, order statistics and digests of rows in order, without a task for each key.

All go by one range shuffle: rows are cut into ranges of (keys, order), so a key of nearly all rows is dealt out
like many keys; ranges are counted by key, and a row's position is its place in its range and what stands in the
ranges before. Orders need a column that tells rows apart, or equal rows stay in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Digests that one digest is made of, and levels of a tree.
FANOUT, LEVELS = 1024, 3
#: monotonically_increasing_id() is the partition times this, plus the place in it.
RANGE = 1 << 33


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pos: str = "pos", total: str = "n") -> DataFrame:
    """rows with their position (from 0) by order within their keys, and the number of rows of those keys.

    The ranges are written to the shared folder and read twice, for counts and for rows, so that both see the
    same ones; give it the columns that are needed, not texts. Null keys are a key, nulls come first.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    by = [*(F.col(k).asc() for k in keys), *order]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at__", F.monotonically_increasing_id())
    path = scratch(spark, "ranges")
    ranged.withColumns({"part__": F.floor(F.col("at__") / RANGE), "at__": F.col("at__") % RANGE}).write.parquet(path)
    ranged = spark.read.parquet(path)
    names = [f"k{i}__" for i in range(len(keys))]
    counts = ranged.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("part__").alias("p__")).agg(F.min("at__").alias("first__"), F.count("*").alias("c__"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # a row for each range
    before = F.coalesce(F.sum("c__").over(whole.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*names, "p__", (before - F.col("first__")).alias("shift__"), F.sum("c__").over(whole).alias("n__"))
    same = F.col("part__") == F.col("p__")
    for k, name in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(name))
    return ranged.join(counts, same).select(*rows.columns, (F.col("at__") + F.col("shift__")).alias(pos), F.col("n__").alias(total))


def medians(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], tie: str) -> DataFrame:
    """keys and the exact median of each value by keys; nulls don't count, keys without a value have null.

    A group's values never meet in one task: the middle rows are found by position. tie tells rows of equal values apart.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name_"), v.cast("double").alias("v_")) for n, v in values.items())))
    long = rows.select(*keys, F.xxhash64(tie).alias("tie_"), each.alias("x_")).select(*keys, "tie_", "x_.*")
    placed = numbered(long.where("v_ is not null"), [*keys, "name_"], ["v_", "tie_"], "at", "of")
    middle = placed.where((F.col("at") >= F.floor((F.col("of") - 1) / 2)) & (F.col("at") <= F.ceil((F.col("of") - 1) / 2)))
    return middle.groupBy(*keys).agg(*(F.avg(F.when(F.col("name_") == n, F.col("v_"))).alias(n) for n in values))


def tree_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], line: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """keys, n, digest: SHA-256 by keys over lines in order, as a tree.

    A leaf is the digest of ``fanout`` lines (with ends of lines), a digest above that of as many digests; the last of ``levels``
    takes what is left, so no task sees more than fanout lines or digests as long as there are
    fanout to the power of levels lines at most.
    """
    placed = numbered(rows.withColumn("line_", line), keys, order, "at_", "n_").select(*keys, "at_", "n_", "line_")
    for level in range(levels):
        up = F.floor(F.col("at_") / fanout) if level < levels - 1 else F.lit(0)
        group = placed.groupBy(*keys, "n_", up.cast("long").alias("up_"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("at_", "line_"))), lambda x: x["line_"])  # fanout at most
        placed = group.agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("line_")).withColumnRenamed("up_", "at_")
    return placed.select(*keys, F.col("n_").alias("n"), F.col("line_").alias("digest"))


def tree_sql(rows: str, keys: str, at: str, line: str, fanout: int = FANOUT, levels: int = LEVELS) -> str:
    """tree_digest as DuckDB SQL: CTEs tree_0 to tree_<levels>, the last with keys, n and line; ``at`` orders rows."""
    out = [f"tree_0 AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {at}) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS n, {line} AS line FROM {rows})"]
    for level in range(levels):
        up = f"place // {fanout}" if level < levels - 1 else "place * 0"
        out.append(f"tree_{level + 1} AS (SELECT {keys}, n, {up} AS place, sha256(string_agg(line, chr(10) ORDER BY place) || chr(10)) AS line FROM tree_{level} GROUP BY {keys}, n, {up})")
    return ", ".join(out)
