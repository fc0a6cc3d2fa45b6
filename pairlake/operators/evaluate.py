"""Splits, control arms, baselines, and inference over errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import medians, numbered


def series_group(series_id: Column, dataset: Column) -> Column:
    """The dataset and the id before its date."""
    return F.concat_ws(":", dataset, F.coalesce(F.nullif(F.regexp_extract(series_id, r"^(.*?)_\d{4}-\d{2}-\d{2}", 1), F.lit("")), series_id))


def time_split(items: DataFrame, cutoff: Column, purge: bool = False) -> DataFrame:
    """items with split train or test by origin; purge: training rows of groups that are tested go."""
    out = items.withColumn("split", F.when(F.col("origin") < cutoff, "train").otherwise("test"))
    if not purge:
        return out
    tested = out.where("split = 'test'").select("grp").distinct()
    return out.where("split = 'test'").unionByName(out.where("split = 'train'").join(tested, "grp", "left_anti"))


def chronological(items: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """By key, the first floor(n share) rows in order train, the rest test."""
    placed = numbered(items, [key], [order], "chrono_at", "chrono_n")
    return placed.withColumn("split", F.when(F.col("chrono_at") < F.floor(F.col("chrono_n") * share), "train").otherwise("test")).drop("chrono_at", "chrono_n")


def _partners(items: DataFrame, strata: str, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(strata, key, digest, pos, n), (strata, n, largest class of equal texts, shift) of strata of two items or more."""
    lot = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), c))
    slim = items.select(strata, key, lot(F.coalesce("text", F.lit(""))).alias("digest"), lot(F.col(key).cast("string")).alias("lot"))
    placed = numbered(slim, [strata], ["digest", "lot", key], "pos", "n").where("n >= 2")
    classes = placed.groupBy(strata, "digest", "n").agg(F.count("*").alias("c")).groupBy(F.col(strata).alias("stratum"), F.col("n").alias("items")).agg(F.max("c").alias("largest"))
    n, m = F.col("items"), F.col("largest")
    free = m + (F.lit(seed * 7919) + n * 104729) % 2147483647 % (n - 2 * m + 1)
    return placed, classes.withColumn("shift", F.when(2 * m <= n, free).when(m < n, m).otherwise(1))


def arms(items: DataFrame, strata: str, key: str, seed: int = 7) -> DataFrame:
    """Three rows for each item: no text, its text, another item's of its stratum; collides: the other's text is equal.

    A stratum's items stand in order of a seeded digest of their texts, so equal texts are neighbours, and take the
    text some places on (cyclic, so texts of a stratum stay the same). The shift is at least the size of the
    largest class of equal texts and at most what is left beside it, by the seed within that: then
    nobody gets an equal text. Where a text has over half of its stratum, as few as can be do (twice the class less the
    stratum). Items alone in their stratum have nobody to swap with and are left out. key tells items apart; null
    texts are empty. Texts move once, by the key of who takes them.
    """
    placed, shifts = _partners(items, strata, key, seed)
    shifted = placed.join(shifts, F.col(strata).eqNullSafe(F.col("stratum")))
    takers = shifted.select(F.col("stratum").alias("s_"), F.col(key).alias("taker_"), F.col("digest").alias("own_"), ((F.col("pos") + F.col("shift")) % F.col("n")).alias("p_"))
    pairs = takers.join(placed, F.col("s_").eqNullSafe(F.col(strata)) & (F.col("p_") == F.col("pos"))).select("taker_", F.col(key).alias("giver_"), (F.col("own_") == F.col("digest")).alias("same_"))
    texts = items.select(F.col(key).alias("from_"), F.coalesce("text", F.lit("")).alias("other_"))
    rows = items.join(pairs, F.col(key) == F.col("taker_")).join(texts, F.col("giver_") == F.col("from_"))
    each = F.array(*(F.struct(F.lit(a).alias("arm"), t.alias("arm_text"), c.alias("collides")) for a, t, c in (("A_no_text", F.lit(""), F.lit(False)), ("B_flywheel_text", F.coalesce("text", F.lit("")), F.lit(False)), ("C_shuffled_text", F.col("other_"), F.col("same_")))))
    return rows.withColumn("a_", F.explode(each)).select(*items.columns, "a_.*")


def arms_report(items: DataFrame, strata: str, key: str, seed: int = 7) -> DataFrame:
    """Of each stratum: items, largest class of equal texts, shift, and rows whose other text is equal to their own."""
    _, shifts = _partners(items, strata, key, seed)
    return shifts.select(F.col("stratum").alias(strata), "items", "largest", "shift", F.greatest(2 * F.col("largest") - F.col("items"), F.lit(0)).alias("collisions"))


def spearman(rows: DataFrame, x: str, y: str, tie: str, *keys: str) -> DataFrame:
    """keys, rho: Pearson of positions, ties by ``tie``; 0 where one doesn't vary."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"rx": F.row_number().over(w.orderBy(x, tie)), "ry": F.row_number().over(w.orderBy(y, tie))})
    rho = F.corr("rx", "ry")
    return placed.groupBy(*keys).agg(F.coalesce(F.when(~F.isnan(rho), rho), F.lit(0.0)).alias("rho"))


def complementarity(errors: DataFrame) -> DataFrame:
    """One row: median gain of the hardest and the easiest quarter by err_a, and of content over shuffled text.

    Quarters go by position and medians by the middle positions, so no task has a quarter.
    """
    slim = errors.select("series_id", "err_a", "err_b", "err_c")
    hard = numbered(numbered(slim, [], [F.desc("err_a"), "series_id"], "d_", "n_"), [], ["err_a", "series_id"], "u_", "n2_")
    q = F.greatest(F.lit(1), F.floor(F.col("n_") / 4))
    gain = F.col("err_a") - F.col("err_b")
    values = {"hard": F.when(F.col("d_") < q, gain), "easy": F.when(F.col("u_") < q, gain), "content": F.col("err_c") - F.col("err_b")}
    out = medians(hard, [], values, "series_id").join(F.broadcast(slim.agg(F.count("*").alias("n"))))  # one row each
    verdict = F.when(F.col("content") > 0.001, "content").when(F.col("content") < -0.05, "harm").otherwise("channel")
    return out.select("n", "hard", "easy", "content", verdict.alias("verdict"))


def draw(seed: int, iteration: Column, number: Column, n: Column) -> Column:
    """A number below n from whole-number arithmetic alone, so that any engine draws the same."""
    x = (iteration.cast("long") * 1000003 + number.cast("long") * 7919 + seed * 104729) % 2147483647
    return (F.floor(((x * 1103515245 + 12345) % 2147483648) / 8) % n).cast("int")


def cluster_bootstrap(rows: DataFrame, group: str, value: str, iterations: int, seed: int, bins: int = 256) -> DataFrame:
    """iter, med: exact medians of rows resampled by whole groups; a draw of a group weighs all its rows.

    Rows aren't repeated for each iteration: they are counted by group and value bin, the weighted counts
    tell the bin that holds each iteration's median, and only the rows of that bin meet the iteration.
    """
    names = rows.select(group).distinct()
    numbered = names.withColumn("group_no", F.row_number().over(Window.orderBy(group)) - 1)  # groups, not rows
    n = numbered.count()
    at = F.col("id")
    draws = rows.sparkSession.range(iterations * n).select(F.floor(at / n).cast("int").alias("iter"), draw(seed, F.floor(at / n), at % n, F.lit(n)).alias("group_no"))
    weights = draws.groupBy("iter", "group_no").agg(F.count("*").alias("times")).join(numbered, "group_no").drop("group_no")
    edges = rows.agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 10_000).alias("e")).first()["e"] or []  # bins numbers
    place = F.size(F.filter(F.array(*(F.lit(float(e)) for e in sorted(set(edges)))), lambda e: e < F.col(value))) if edges else F.lit(0)
    binned = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"), place.alias("bin"))
    counts = binned.groupBy(group, "bin").agg(F.count("*").alias("n"))
    per = counts.join(weights, group).groupBy("iter", "bin").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    one = Window.partitionBy("iter")
    per = per.withColumn("up", F.sum("n").over(one.orderBy("bin"))).withColumn("total", F.sum("n").over(one))
    per = per.withColumn("lo", F.floor((F.col("total") - 1) / 2)).withColumn("hi", F.ceil((F.col("total") - 1) / 2))
    need = per.where((F.col("up") > F.col("lo")) & (F.col("up") - F.col("n") <= F.col("hi"))).select("iter", "bin", (F.col("up") - F.col("n")).alias("before"), "lo", "hi")
    some = binned.join(need, "bin").join(weights, ["iter", group])
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("iter", "bin").orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("upto", upto)
    at = lambda c: F.min(F.when(F.col("upto") > F.col(c), F.col("v")))
    return some.groupBy("iter").agg(((at("lo") + at("hi")) / 2).alias("med"))


def interval(meds: DataFrame, n: int) -> DataFrame:
    """lo and hi: the 2.5 and 97.5 index percentiles of n medians (iter, med)."""
    return meds.agg(F.array_sort(F.collect_list("med")).alias("m")).select(F.get("m", F.lit(int(0.025 * n))).alias("lo"), F.get("m", F.lit(int(0.975 * n))).alias("hi"))


def distinct_from(rows: DataFrame, pool: DataFrame, key: str, others: bool, k: int = 20) -> DataFrame:
    """series_id, disc: how well a description (said) fits its own series (own) less its mean fit to k others of its key.

    rows: series_id, key, r (number from 0), own, said; pool: key, r, own. others: the pool is rows itself,
    and nobody is drawn as its own distractor. Draws are by number, so they are an equi-join.
    """
    n = pool.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("n"))
    r = rows.join(n, rows[key] == n["of"]).where(F.col("n") >= (2 if others else 1)).drop("of")
    step = F.col("r") * 7919 + F.col("j") * 104729
    at = (F.col("r") + 1 + step % (F.col("n") - 1)) % F.col("n") if others else step % F.col("n")
    drawn = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("p", at)
    theirs = pool.select(F.col(key).alias("their_key"), F.col("r").alias("their_r"), F.col("own").alias("theirs"))
    met = drawn.join(theirs, (F.col(key) == F.col("their_key")) & (F.col("p") == F.col("their_r")))
    rate = lambda c: F.when(F.size("said") > 0, F.size(F.filter("said", lambda s: F.array_contains(c, s))) / F.size("said")).otherwise(0.0)
    out = met.groupBy("series_id", F.col(key)).agg(F.max(rate("own")).alias("fits"), F.avg(rate("theirs")).alias("else_"))
    return out.select("series_id", key, (F.col("fits") - F.col("else_")).alias("disc"))


def probe(rows: DataFrame, alarm: float = 0.15) -> DataFrame:
    """One row for errors a, b, c, ba of four arms: medians, wins of b, the gain that ba retains, rows whose arms all agree."""
    out = rows.agg(*(F.median(x).alias(x) for x in ("a", "b", "c", "ba")), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("b_over_a"), F.count_if(F.col("b") < F.col("c")).alias("b_over_c"), F.count_if((F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))).alias("degenerate"))
    gain = F.when(F.col("a") != F.col("b"), (F.col("a") - F.col("ba")) / (F.col("a") - F.col("b")) * 100).otherwise(0.0)
    return out.select("*", gain.alias("retained"), (F.col("degenerate") > alarm * F.col("n")).alias("unreliable"))


def tfidf(docs: DataFrame, name: str, text: str, stop: tuple[str, ...] = (), least_df: int = 2) -> DataFrame:
    """name, term, weight: term counts times ln(N / df) + 1 for terms of two names or more, unit length by name."""
    words = docs.select(name, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    tf = words.where(~F.col("term").isin(*stop)).groupBy(name, "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.countDistinct(name).alias("names"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    w = tf.join(df, "term").join(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log(F.col("names") / F.col("df")) + 1)).drop("names")
    length = w.groupBy(name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, name).select(name, "term", (F.col("w") / F.col("length")).alias("weight"))


def cosines(weights: DataFrame, name: str) -> DataFrame:
    """a, b, cosine of each pair of names that share a term; names are sources, which are few."""
    a = weights.select(F.col(name).alias("a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col(name).alias("b"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
