"""Quality rules: base statistics of texts, and robust multivariate outliers. DataFrame functions only.

Base: words, their characters, symbols, repeated lines, and words in five-word windows found twice;
a text fails with under 10 words or over a fifth of its words in such windows.

Method: for each language and source, a minimum covariance determinant estimate of the transformed
statistics of texts that pass the base. Three starts (distances by medians and absolute deviations, the
same by the largest component, and by plain mean and covariance) choose a first three quarters of a
group; each concentration step takes the three quarters that are nearest by Mahalanobis distance and
estimates mean and covariance from them, until no determinant falls any more; of a group's starts the
smallest determinant wins. The distance that parts the quarters comes from a histogram of distances by
group (some hundred bins each, which carry their sums and sums of products), so no group is sorted or
gathered, a step reads the rows once, a group with a third of all rows is aggregated like any other, and all rows count. FACTOR makes the covariance of the nearest three quarters
of normal data that of all; a floor (FLOORS) is added to variances, as many clean texts have no symbol
and no repeat at all, so that their spread says nothing. The length of words is measured from its group's
median, so that it doesn't follow the size of a text. Every estimate is drawn to that of its language,
and that to the estimate of all, by their sizes (SHRINK texts weigh as much as the pool), so a small
group is judged like its language. A text is kept if its squared distance is within CUTOFF.

Null or empty text has no words and fails the base. Null language or source is a group like others.
Repeated rows are judged each, a null doc_id keeps its row, an empty table gives no rows, other columns
are not read. A very long text costs memory in proportion to its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: Share of a group that an estimate rests on, most steps, least fall of a log determinant, texts that weigh as much as the pool.
SHARE, STEPS, FALL, SHRINK = 0.75, 12, 1e-3, 60
STARTS = 3
#: Groups whose estimates may go to every task; of more only those with the share LARGE of the rows do, the others are joined by key.
BROADCAST, LARGE = 50_000, 0.001
#: Fixed values for five dimensions and a share of 0.75: the consistency factor of the covariance.
FACTOR = 1.41
#: Largest squared distance that is kept: the 0.999 quantile of chi-squared with five degrees of freedom.
CUTOFF = 20.515
#: Least standard deviation of each transformed statistic. Size and length have a spread of their own. Most clean
#: texts have no symbol and no repeat: the floor there is less than a symbol in 20 words or one repeated line adds.
FLOORS = {"size": 0.05, "length": 0.05, "symbols": 0.15, "lines": 0.2, "repeats": 0.2}
NAMES = list(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
FIELDS = [f"m_{a}" for a in NAMES] + [f"c_{i}_{j}" for i, j in PAIRS]

WHITE = " \t\n\x0b\f\r"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"))
    trimmed = F.btrim("text", F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.withColumns({"w": words, "l": lines})
    rows = rows.select(
        "doc_id", "lang", "source", "w",
        F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("hs", F.when(F.col("n") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    # only texts in which two windows have one hash sort their windows
    placed = F.array_sort(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("hs")) < F.size("hs"), placed).otherwise(none))

    def same(x: Column, k: Column) -> Column:
        """Whether the sorted window k is the one at x: equal hashes, then equal words."""
        y = F.get("s", k)
        return (y["h"] == x["h"]) & (F.slice("w", x["p"] + 1, WINDOW) == F.slice("w", y["p"] + 1, WINDOW))

    twice = F.filter("s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    rows = rows.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["p"])))
    gaps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda a, b: F.least(F.lit(WINDOW), a - b))
    covered = F.when(F.size("p") == 0, 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b)).cast("long")
    n = F.col("n").cast("long")
    rows = rows.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "size": F.log(n),
        "length": (F.col("log_length") - F.col("usual")) * F.sqrt(F.least(n, F.lit(400)) / 40),  # short texts vary more
        "symbols": F.log1p(20 * F.col("n_symbols") / n),
        "lines": F.log1p(5 * F.col("n_dup_lines") / F.sqrt(n)),
        "repeats": F.log1p(10 * F.col("n_repeat_words") / n),
    }


def _factored(params: DataFrame) -> DataFrame:
    """With the Cholesky factor l_i_j of the covariance c_i_j, the factor's inverse w_i_j, and det, the log determinant."""
    out = []
    for i, j in PAIRS:
        done = " - ".join([f"c_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        # no less than a hundredth of the floor is left by what the others explain
        out.append(f"sqrt(greatest({done}, {0.01 * FLOORS[NAMES[i]] ** 2}D)) AS l_{i}_{i}" if i == j else f"({done}) / l_{j}_{j} AS l_{i}_{j}")
    for i, j in PAIRS:
        done = " + ".join(f"l_{i}_{k} * w_{k}_{j}" for k in range(j, i))
        out.append(f"1 / l_{i}_{i} AS w_{i}_{i}" if i == j else f"-({done}) / l_{i}_{i} AS w_{i}_{j}")
    return params.selectExpr("*", *out, "2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(len(NAMES))) + ") AS det")


def _distance(of: str = "") -> Column:
    """Squared Mahalanobis distance; of: the struct in which means and inverse factors are."""
    y = [" + ".join(f"{of}w_{i}_{j} * ({NAMES[j]} - {of}m_{NAMES[j]})" for j in range(i + 1)) for i in range(len(NAMES))]
    return F.expr(" + ".join(f"pow({v}, 2)" for v in y))


def _large(sizes: DataFrame) -> DataFrame | None:
    """The keys of sizes (key, n) with the share LARGE of the rows or more, 1 / LARGE of them at most; None where all keys are few."""
    groups, rows = sizes.agg(F.count("*"), F.sum("n")).first()
    return None if groups <= BROADCAST else written(sizes.where(F.col("n") >= rows * LARGE).select("key"), "outliers")


def _by_key(rows: DataFrame, params: DataFrame, large: DataFrame | None) -> DataFrame:
    """rows with the params of their key. Of very many keys only the large ones go to every task, the others are joined by key."""
    if large is None:
        return rows.join(F.broadcast(params), "key")
    large = F.broadcast(large)
    hot = rows.join(F.broadcast(params.join(large, "key")), "key")
    return hot.unionByName(rows.join(large, "key", "left_anti").join(params.hint("merge"), "key"))


def _covered(cov: Callable[[int, int], Column]) -> list[Column]:
    """c_i_j: the covariances with their factor and floors."""
    return [(FACTOR * cov(i, j) + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS]


def _nearest(rows: DataFrame) -> DataFrame:
    """key, its origin o_*, and for each start a struct of the estimate from the three quarters with the smallest distance.

    rows: key, o_* (near the middle of the group), the statistics, and far, for each start a distance (d2) and the log
    determinant that it comes from (before). Each bin of distances has its count, sums and sums of products from the
    origin; the bins of the nearest quarters are added up, so one pass over the rows finds the quarters and their estimate.
    """
    origin = [f"o_{a}" for a in NAMES]
    each = rows.select("key", *origin, *((F.col(a) - F.col(f"o_{a}")).alias(a) for a in NAMES), F.posexplode("far").alias("start", "far"))
    each = each.select("*", F.floor(16 * F.log2(1 + 16 * F.col("far.d2"))).alias("bin"))
    sums = {"n": "count(*)", **{f"s_{a}": f"sum({a})" for a in NAMES}, **{f"q_{i}_{j}": f"sum({NAMES[i]} * {NAMES[j]})" for i, j in PAIRS}}
    same = [F.first(c).alias(c) for c in (*origin, "before")]
    bins = each.withColumn("before", F.col("far.before")).groupBy("key", "start", "bin").agg(*(F.expr(c).alias(k) for k, c in sums.items()), *same)
    by = Window.partitionBy("key", "start")  # a row for each bin
    bins = bins.repartition("key").withColumns({"up": F.sum("n").over(by.orderBy("bin")), "total": F.sum("n").over(by)})
    near = bins.where(F.col("up") - F.col("n") < SHARE * F.col("total")).groupBy("key", "start").agg(*(F.sum(k).alias(k) for k in sums), *same)
    mean = {a: F.col(f"s_{a}") / F.col("n") for a in NAMES}
    cov = lambda i, j: F.col(f"q_{i}_{j}") / F.col("n") - mean[NAMES[i]] * mean[NAMES[j]]
    found = _factored(near.select("key", "start", *origin, "before", *((F.col(f"o_{a}") + mean[a]).alias(f"m_{a}") for a in NAMES), *_covered(cov)))
    of = F.struct("det", "before", *FIELDS, *(f"w_{i}_{j}" for i, j in PAIRS))
    return found.groupBy("key").agg(*(F.first(c).alias(c) for c in origin), *(F.max(F.when(F.col("start") == s, of)).alias(f"of_{s}") for s in range(STARTS)))


def estimates(rows: DataFrame) -> DataFrame:
    """key, n, m_* and c_i_j: the robust mean and covariance of each key."""
    medians = [F.percentile_approx(a, 0.5, 1000).alias(f"o_{a}") for a in NAMES]
    plain = [F.avg(a).alias(f"m_{a}") for a in NAMES] + _covered(lambda i, j: F.covar_pop(NAMES[i], NAMES[j]))
    first = written(rows.groupBy("key").agg(F.count("*").alias("n"), *medians, *plain), "medians")
    large = _large(first)
    origin = first.select("key", *(f"o_{a}" for a in NAMES))
    away = _by_key(rows, origin, large).groupBy("key").agg(*(F.percentile_approx(F.abs(F.col(a) - F.col(f"o_{a}")), 0.5, 1000).alias(f"d_{a}") for a in NAMES))
    start = written(_factored(first).join(away, "key"), "spreads")
    z = [((F.col(a) - F.col(f"o_{a}")) ** 2) / ((1.4826 * F.col(f"d_{a}")) ** 2 + FLOORS[a] ** 2) for a in NAMES]
    far = lambda *distances: F.array(*(F.struct(d.alias("d2"), b.cast("double").alias("before")) for d, b in distances))
    none = F.lit(None)
    params = written(_nearest(_by_key(rows, start, large).withColumn("far", far((sum(z[1:], z[0]), none), (F.greatest(*z), none), (_distance(), none)))), "outliers")
    of = [F.col(f"of_{s}") for s in range(STARTS)]
    far = far(*((_distance(f"of_{s}."), o["det"]) for s, o in enumerate(of)))
    for _ in range(STEPS):
        new = written(_nearest(_by_key(rows, params, large).withColumn("far", far)), "outliers")
        fell = new.agg(F.max(F.greatest(*(o["before"] - o["det"] for o in of)))).first()[0]
        dropped(params)
        params = new
        if fell is None or fell <= FALL:
            break
    best = params.select("key", F.array_min(F.array(*of)).alias("b"))
    return written(best.join(first.select("key", "n"), "key").select("key", "n", *(f"b.{f}" for f in FIELDS)), "outliers")


ALL = "all"


def _name(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _drawn(own: DataFrame, pool: DataFrame) -> DataFrame:
    """own (key, above, n and an estimate) drawn to the estimate of the pool that is above it."""
    w = F.col("n") / (F.col("n") + SHRINK)
    pool = pool.select(F.col("key").alias("above"), *(F.col(f).alias(f"p_{f}") for f in FIELDS))
    mixed = [(w * F.col(f) + (1 - w) * F.col(f"p_{f}")).alias(f) for f in FIELDS]
    return own.join(pool, "above").select("key", "n", *mixed)


def shrunk(rows: DataFrame) -> DataFrame:
    """key, m_*, c_i_j for each language and source, from rows (key, pool, and the statistics)."""
    each = rows.select(F.explode(F.array(F.concat(F.lit("s"), "key"), F.concat(F.lit("l"), "pool"), F.lit(ALL))).alias("key"), *NAMES)
    found = estimates(each)
    above = rows.select(F.concat(F.lit("s"), "key").alias("key"), F.concat(F.lit("l"), "pool").alias("above")).distinct()
    every = found.where(F.col("key") == ALL)
    pools = _drawn(found.where(F.startswith("key", F.lit("l"))).withColumn("above", F.lit(ALL)), every)
    own = _drawn(found.where(F.startswith("key", F.lit("s"))).join(above, "key"), pools)
    return written(own.withColumn("key", F.substring("key", 2, 1 << 30)), "estimates")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, distance (null where the base fails)."""
    rows = written(statistics(docs), "statistics")
    fine = rows.where(~F.col("base_failed")).withColumns({"log_length": F.log(F.col("word_chars") / F.col("n_words")), "key": _name("lang", "source"), "pool": _name("lang")})
    usual = written(fine.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("log_length", 0.5, 1000).alias("usual")), "usual")
    large = _large(usual)
    fine = written(_by_key(fine, usual.drop("n"), large).withColumns(_vector()), "vectors")
    params = shrunk(fine)
    far = _by_key(fine, _factored(params).drop("n"), large).withColumn("distance", _distance())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = far.select(*columns, (F.col("distance") <= CUTOFF).alias("kept"), "distance")
    return passed.union(rows.where("base_failed").select(*columns, F.lit(False), F.lit(None).cast("double")))
