"""Invariants and small cases of the operators, sources, and streams."""

import datetime as dt
import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pairlake.functions import lexical as L
from pairlake.functions import series as S
from pairlake.operators import brier as B
from pairlake.operators import detect as D
from pairlake.operators import emit as M
from pairlake.operators import evaluate as E
from pairlake.operators import governance as G
from pairlake.operators import order as O
from pairlake.operators import pairs as P
from pairlake.operators import probe
from pairlake.operators import retrieve as R
from pairlake.operators import validate as C


@pytest.mark.parametrize("n", [2, 3, 40, 500])
def test_arms_are_a_derangement(spark, n):
    items = spark.createDataFrame([(f"s{i}", f"d{i % 2 if n > 3 else 0}", f"t{i}") for i in range(n)], "series_id string, ds string, text string")
    got = E.arms(items, "ds", "series_id").toPandas()
    own, other = got[got.arm == "B_flywheel_text"].set_index("series_id").arm_text, got[got.arm == "C_shuffled_text"].set_index("series_id").arm_text
    assert len(own) == n and (own != other[own.index]).all() and sorted(own) == sorted(other)


@pytest.mark.parametrize("sizes", ([1, 1, 1, 1], [5, 3, 2], [6, 4, 2, 1], [7, 1, 1, 1], [4], [40, 30, 29, 1]))
def test_arms_part_equal_texts(spark, sizes):
    """Nobody gets an equal text, or as few as can be; texts of a stratum stay the same, also beside another stratum and with null texts."""
    texts = [f"t{i}" if i else None for i, n in enumerate(sizes) for _ in range(n)]
    rows = [(f"s{i * 37 % 1009}", "x", t) for i, t in enumerate(texts)] + [("y1", "y", "t0"), ("y2", "y", "t1"), ("z", "z", "t")]
    items = spark.createDataFrame(rows, "series_id string, ds string, text string").repartition(3)
    got = E.arms(items, "ds", "series_id").toPandas()
    least = max(0, 2 * max(sizes) - len(texts))
    for ds, want in (("x", least), ("y", 0)):
        arm = {a: got[(got.arm == a) & (got.ds == ds)].set_index("series_id") for a in got.arm.unique()}
        own, other = arm["B_flywheel_text"].arm_text, arm["C_shuffled_text"].arm_text
        assert (own == other[own.index]).sum() == arm["C_shuffled_text"].collides.sum() == want and sorted(own) == sorted(other)
    assert {(r.ds, r["items"], r.largest, r.collisions) for r in E.arms_report(items, "ds", "series_id").collect()} == {("x", len(texts), max(sizes), least), ("y", 2, 1, 0)}
    assert E.arms(items.limit(0), "ds", "series_id").count() == 0


def test_arms_follow_their_seed(spark):
    items = spark.createDataFrame([(f"s{i}", "x", f"t{i % 30}") for i in range(90)], "series_id string, ds string, text string")
    c = lambda seed: sorted((r.series_id, r.arm_text) for r in E.arms(items, "ds", "series_id", seed).where("arm = 'C_shuffled_text'").collect())
    assert c(1) == c(1) != c(2)


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot(n=4000):
    """A key with nine rows of ten, some keys of a few rows, a null key."""
    return [("hot" if i % 10 else None if i % 50 == 0 else f"k{i % 7}", (i * 7919) % 101 / 4, i) for i in range(n)]


def test_positions_of_a_hot_key(spark, many_ranges):
    """Positions by key and order; the hot key is dealt over many ranges."""
    rows = hot()
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {r.id: (r.pos, r.n) for r in O.numbered(df, ["k"], [F.desc("v"), "id"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]
    parts = df.repartitionByRange(16, "k", F.desc("v"), "id").where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 800
    whole = {r.id: r.pos for r in O.numbered(df, [], ["id"]).collect()}
    assert whole == {i: i for i in range(len(rows))} and O.numbered(df.limit(0), ["k"], ["id"]).count() == 0


def test_medians_of_a_hot_key(spark, many_ranges):
    rows = [(*r, None if r[2] % 3 else r[1] * r[1]) for r in hot()] + [("none", None, -1, None)]
    df = spark.createDataFrame(rows, "k string, v double, id long, w double")
    got = {r.k: (r.a, r.b) for r in O.medians(df, ["k"], {"a": F.col("v"), "b": F.col("w")}, "id").collect()}
    of = lambda k, i: [r[i] for r in rows if r[0] == k and r[i] is not None]
    assert got == {k: tuple(statistics.median(of(k, i)) for i in (1, 3)) for k in {r[0] for r in rows} - {"none"}}


def test_tree_digest_of_a_hot_key(spark, many_ranges):
    """Like the tree made in order, whatever the partitions; another line gives another digest; no list is longer than the fanout."""
    rows = [(k, i) for k, _, i in hot(700)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(5)
    got = {r.k: (r.n, r.digest) for r in O.tree_digest(df, ["k"], ["id"], F.col("id").cast("string"), fanout=10).collect()}
    for k in {r[0] for r in rows}:
        lines = [str(i) for i in sorted(i for x, i in rows if x == k)]
        n = len(lines)
        for level in range(3):
            step = 10 if level < 2 else len(lines)
            lines = [hashlib.sha256(("\n".join(lines[at : at + step]) + "\n").encode()).hexdigest() for at in range(0, len(lines), step)]
        assert got[k] == (n, lines[0])
    assert O.tree_digest(df.where("id <> 5"), ["k"], ["id"], F.col("id").cast("string"), fanout=10).where("k = 'hot'").first().digest != got["hot"][1]


def test_first_values_of_a_hot_key(spark):
    rows = hot()
    got = {r.k: r["first"] for r in R.first_of(spark.createDataFrame(rows, "k string, v double, id long"), ["k"], "id", 5).collect()}
    assert got == {k: sorted(r[2] for r in rows if r[0] == k)[:5] for k in {r[0] for r in rows}}


@pytest.mark.parametrize("width,shape", [(1, "random"), (2, "falling"), (1, "rising"), (512, "random"), (3, "equal")])
def test_spaced_like_the_greedy_choice(spark, width, shape):
    """Units of a few spacings, also where each choice depends on the one before along the whole series."""
    import random

    r = random.Random(width)
    rank = {"random": lambda i: r.random(), "falling": lambda i: -i, "rising": lambda i: i, "equal": lambda i: 0}[shape]
    rows = [(k, i // 2 if shape == "random" else i, float(rank(i)), f"x{i}") for k in ("a", "b") for i in range(-40, 60) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, idx int, v double, note string")
    want = set()
    for k in "ab":
        taken = []
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1], int(x[3][1:]))):
            if all(abs(x[1] - t[1]) >= 5 for t in taken):
                taken.append(x)
        want |= {(i, *x) for i, x in enumerate(taken)}
    number = F.substring("note", 2, 9).cast("int")
    get = lambda top: {tuple(x) for x in D.spaced(df, "k", [F.col("v"), F.col("idx"), number], 5, top, width).collect()}
    assert get(None) == {x[1:] for x in want} and get(3) == {x[1:] for x in want if x[0] < 3}
    assert D.spaced(df.limit(0), "k", [F.col("v")], 5).count() == 0


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_publish", "_swept", None])
def test_json_lines_survive_a_killed_writer(spark, tmp_path, monkeypatch, step):
    """Old rows whole until the new version is published, then new rows whole; never none and never some."""
    from pairlake.sources import files

    def killed(*_):
        raise Killed

    path = f"file://{tmp_path}/out"
    read = lambda: sorted(r.id for r in files.json_lines(spark, path, "id long").collect())
    for n in (5, 3):
        files.write_json_lines(spark.range(n), path)
    assert read() == [0, 1, 2]
    early = files.json_lines(spark, path, "id long")
    if step:
        with monkeypatch.context() as m:
            m.setattr(files, step, killed)
            with pytest.raises(Killed):
                files.write_json_lines(spark.range(7), path)
    assert read() == (list(range(7)) if step == "_swept" else [0, 1, 2])
    assert files.write_json_lines(spark.range(4), path) == 4 and read() == [0, 1, 2, 3]
    if step != "_swept":
        assert early.count() == 3  # the version before is still there for who began to read it
    assert len(files._manifests(spark, path)) == 2


def test_a_file_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    from pairlake.sources import files

    path = tmp_path / "x.json"
    files.write_json(spark, {"b": 1, "a": "é"}, f"file://{path}")
    before = path.read_text()
    with monkeypatch.context() as m:
        m.setattr(files, "_replace", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            files.write_json(spark, {"a": 2}, f"file://{path}")
    assert path.read_text() == before and json.loads(before) == {"a": "é", "b": 1}
    files.write_json(spark, {"a": 2}, f"file://{path}")
    assert json.loads(path.read_text()) == {"a": 2}


def test_singleton_stratum_has_no_arms(spark):
    assert E.arms(spark.createDataFrame([("a", "x", "t")], "series_id string, ds string, text string"), "ds", "series_id").count() == 0


def test_time_split_purges_groups(spark):
    day = dt.date
    items = spark.createDataFrame([("a-old", "a", day(2023, 1, 1)), ("a-new", "a", day(2024, 5, 1)), ("b-old", "b", day(2023, 2, 1))], "id string, grp string, origin date")
    got = {r.id: r.split for r in E.time_split(items, F.lit("2024-01-01").cast("date"), purge=True).collect()}
    assert got == {"a-new": "test", "b-old": "train"}


def test_cluster_bootstrap_draws_groups(spark):
    rows = spark.createDataFrame([(-1.0, "same"), (-2.0, "same"), (3.0, "other")], "d double, g string")
    meds = {r.med for r in E.cluster_bootstrap(rows, "g", "d", 50, 3).collect()}
    assert meds == {-1.5, -1.0, 3.0}


def test_detection_spaces_moves(spark):
    series = spark.createDataFrame([("a", i, 100.0 + (50 if i in (30, 33, 60) else 0) + i % 3) for i in range(90)], "series_id string, idx int, price double")
    got = sorted(r.idx for r in D.detect_threshold(series, 0.3, 10, 8).collect())
    assert all(b - a >= 10 for a, b in zip(got, got[1:])) and len(got) == 2
    assert D.detect_threshold(series.limit(0), 0.3).count() == 0
    assert D.k_returns(spark.createDataFrame([("a", 0, 0.0), ("a", 1, 5.0)], "series_id string, idx int, price double"), 1).count() == 0


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 4), (3, "j", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, "five"), ("k", 3, "three")], "k string, t int, v string")
    get = lambda strict: {r.id: r.right_v for r in R.asof_backward(left, right, "t", ["k"], ["v"], strict).collect()}
    assert get(False) == {1: "five", 2: "three", 3: None}
    assert get(True) == {1: "three", 2: "three", 3: None}


def test_even_spread_picks_by_index(spark):
    rows = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert sorted(r.i for r in R.even_spread(rows, ["g"], ["i"], 4).collect()) == [int(i * 10 / 4) for i in range(4)]
    assert R.even_spread(rows, ["g"], ["i"], 0).count() == 10


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return row.select(column.alias("x")).first().x


def test_lexical_gates(spark):
    assert one(spark, F.col("t").rlike(L.PRICE_PROJECTION), t="A price target of 90") and not one(spark, F.col("t").rlike(L.PRICE_PROJECTION), t="OPEC's demand growth forecast")
    assert one(spark, F.col("t").rlike(L.DIRECTION), t="It will go up") and not one(spark, F.col("t").rlike(L.DIRECTION), t="The yield rose in December")
    assert one(spark, L.entities(F.col("t")), t="The Saudi Aramco deal hit OPEC and Russia; opec fell") == ["OPEC", "Saudi Aramco", "Saudi", "Russia"]
    assert one(spark, L.traced(F.lit("International Energy Agency"), F.col("g")), g="IEA warns") and not one(spark, L.traced(F.lit("Atlantis Ministry"), F.col("g")), g="IEA warns")
    assert sorted(one(spark, L.policy_numbers(F.col("t")), t="1-3/4 to 2 percent, 1/4")) == [0.25, 1.75, 2.0]
    assert one(spark, L.future_year(F.col("t"), F.lit("2024-01-01")), t="by 2030") and not one(spark, L.future_year(F.col("t"), F.lit("bad")), t="by 2030")


def test_numeric_arrays(spark):
    assert one(spark, S.linear_trend(F.col("h"), 2), h=[1.0, 2.0, 3.0]) == [4.0, 5.0]
    assert one(spark, S.linear_trend(F.col("h"), 2), h=[5.0]) == [5.0, 5.0]
    assert one(spark, S.finite(F.col("h")), h=[1.0, float("nan")]) is False
    assert one(spark, S.sparkline(F.col("h")), h=[0.0, 1.0]) == "▁█"
    assert one(spark, B.p_up(F.col("q"), (0.1, 0.5, 0.9), F.lit(2.0)), q=[1.0, 2.0, 3.0]) == 0.5


def test_text_seams(spark):
    assert one(spark, P.clean_answer(F.col("t")), t="It rose <ts></ts> , then fell.. ") == "It rose, then fell."
    assert one(spark, P.pretraining_text(F.col("t"), F.lit(2)), t="Rose. ") == "Rose. <ts></ts><ts></ts>"
    assert one(spark, P.place(F.col("t")), t="2011 Tohoku Earthquake") == "Tohoku"


def test_governance_fails_closed(spark):
    reg = spark.createDataFrame([("a", "approved", "MIT", "u", None)], "source string, status string, license string, terms_url string, attribution string")
    alias = spark.createDataFrame([("b", "a")], "alias string, source string")
    got = G.decisions(spark.createDataFrame([("a",), ("b",), ("zzz",)], "ds string"), reg, alias, "ds").withColumn("e", G.release_errors())
    assert {r.ds: (r.status, list(r.e)) for r in got.collect()} == {"a": ("approved", []), "b": ("approved", []), "zzz": ("review_required", ["not_releasable", "license_missing", "terms_url_missing"])}


def test_validator_catches_each_defect(spark, sf):
    from pairlake.queries.validation import validate_chatml

    got = validate_chatml(spark, sf).toPandas()
    assert (got[got.k == 0].errors == "").all() and (got[got.k > 0].errors != "").all()
    first = dict(got.drop_duplicates("k").set_index("k").errors)
    assert "span_len" in first[1] and "role" in first[2] and "non_finite" in first[3] and "loss_start" in first[4] and "ranges_not_empty" in first[5] and "text_missing" in first[6]
    assert one(spark, F.col("f").rlike(C.FREQUENCY), f="1M") and not one(spark, F.col("f").rlike(C.FREQUENCY), f="x")


def test_files(spark, tmp_path):
    from pairlake.sources import files

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\nbroken\n')
    (tmp_path / "b.json").write_text('[{"x": 3}, {"x": 4}]')
    (tmp_path / "c.jsonl").write_text('{"x": 5}{"x": 6}')
    (tmp_path / "d.rejected.jsonl").write_text('{"x": 7}\n')
    got = files.json_records(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r.record)["x"] for r in got if r.record) == [1, 2, 3, 4, 5, 6] and [r.corrupt for r in got if r.corrupt] == ["broken"]
    (tmp_path / "p.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,.\nnote,3\n2020-01-03,\n")
    assert [tuple(r) for r in files.price_csv(spark, str(tmp_path / "p.csv")).collect()] == [("2020-01-01", 1.5)]
    (tmp_path / "y.xml").write_text('<feed xmlns:m="m" xmlns:d="d"><m:properties><d:NEW_DATE>2020-01-02T00:00:00</d:NEW_DATE><d:BC_2YEAR>1.5</d:BC_2YEAR><d:BC_10YEAR>2.5</d:BC_10YEAR></m:properties><m:properties><d:NEW_DATE>2020-01-03T00:00:00</d:NEW_DATE><d:BC_2YEAR>1.0</d:BC_2YEAR></m:properties></feed>')
    assert [tuple(r) for r in files.yields_xml(spark, str(tmp_path / "y.xml")).collect()] == [("2020-01-02", 1.5, 2.5)]
    out = str(tmp_path / "out")
    assert files.write_json_lines(spark.range(3), out) == 3 and files.write_json_lines(spark.range(2), out) == 2
    assert spark.read.json(files.current(spark, out)).count() == 2
    (tmp_path / "e.csv").write_text("#model_version:v1,score_date:2024-01-02T00:00:00\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,0.1,0.2\n")
    targets = spark.createDataFrame([("CVE-1",)], "cve string")
    assert [tuple(r) for r in files.epss_csv(spark, str(tmp_path / "e.csv"), "2024-01-02", targets).collect()] == [("CVE-1", 50.0)]
    with pytest.raises(ValueError):
        files.epss_csv(spark, str(tmp_path / "e.csv"), "2024-01-03", targets)


def test_equal_models_rank_by_name(spark):
    """Models of the same scores in other orders and places are level, and their names decide; NaN and null stay what they were."""
    r = random.Random(4)
    scores = [(r.choice(("fred", "yahoo")), r.randrange(11) / 100 * 10, float(r.randrange(2))) for _ in range(400)]
    rows = [(f"m{m:02}", *s) for m in range(12) for s in r.sample(scores, len(scores))]
    df = spark.createDataFrame(rows, "model string, domain string, forecast double, resolved_to double")
    for parts in (1, 7):
        got = B.leaderboard(df.repartition(parts), least=20).orderBy("rank").collect()
        assert [x.model for x in got] == sorted(x.model for x in got) and len({(x.b, x.f, x.y) for x in got}) == 1
    odd = spark.createDataFrame([(0, 1.5), (0, None), (1, float("nan")), (1, 1.0), (2, None), (3, 1e300), (3, 3e300), (4, float("inf"))], "k int, x double")
    got = {x.k: x.m for x in odd.groupBy("k").agg(S.steady_mean(F.col("x")).alias("m")).collect()}
    assert got[0] == 1.5 and got[1] != got[1] and got[2] is None and got[3] == 2e300 and got[4] == float("inf")


def test_windows_of_snapshots(spark):
    """Edges of a window are in it, also across spans and before 1970; a target is never a row for each day, nor broadcast."""
    import datetime

    from pairlake.sources import files

    day = lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(n)
    added = [(i, day(a)) for i in range(3) for a in (-40, -1, 0, 17, 29)] + [(3, None), (None, day(0))]
    scores = [(i, day(d), float(d)) for i in (0, 2, 3) for d in range(-80, 80, i + 1)] + [(None, day(0), 1.0), (0, None, 2.0)]
    targets, snapshots = spark.createDataFrame(added, "id long, added date"), spark.createDataFrame(scores, "id long, day date, score double")
    got = files.snapshots_window(targets, snapshots, 21, 8, 10)
    want = {(i, a): [s for j, d, s in scores if j == i and d and a - datetime.timedelta(21) <= d <= a + datetime.timedelta(8)] for i, a in added if a and i is not None}
    assert {(r.id, r.added): r["values"] for r in got.collect()} == {k: v for k, v in want.items() if len(v) >= 10}
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, sf, tmp_path):
    from pairlake.streaming import events as V

    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    V.run_once(V.hourly(V.read(spark, str(tmp_path / "in")), "60 days"), "hours", "complete", str(tmp_path / "ck"))
    got = {(r.hour, r.entity): r.v for r in spark.table("hours").collect()}
    want = {(r.hour, r.entity): r.v for r in batch.groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("entity")).agg(F.count("*").alias("v")).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_asof_ranges_carry_over_empty_ranges(spark):
    """The last right row may lie many ranges back; keys and no keys alike."""
    left = spark.createDataFrame([(i, "k", 10 * i) for i in range(50)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 15, "a"), ("k", 260, "b"), ("j", 5, "c"), ("k", 260, "bb")], "k string, t int, v string")
    got = {r.id: r.right_v for r in R.asof_backward(left, right, "t", ["k"], ["v"], False, days=7).collect()}
    assert got == {i: None if 10 * i < 15 else "a" if 10 * i < 260 else "bb" for i in range(50)}
    free = {r.id: r.right_v for r in R.asof_backward(left, right, "t", [], ["v"], True, days=7).collect()}
    assert free == {i: None if 10 * i <= 5 else "c" if 10 * i <= 15 else "a" if 10 * i <= 260 else "bb" for i in range(50)}
    assert R.asof_backward(left, right.limit(0), "t", [], ["v"], True).where("right_v is null").count() == 50


def test_bootstrap_medians_like_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    g, v = r.integers(0, 9, 400), r.normal(size=400).round(2)
    rows = spark.createDataFrame([(f"g{a}", float(b)) for a, b in zip(g, v)], "g string, d double")
    got = {x.iter: x.med for x in E.cluster_bootstrap(rows, "g", "d", 40, 5, bins=8).collect()}
    for i in range(40):
        drawn = [(((i * 1000003 + j * 7919 + 5 * 104729) % 2147483647 * 1103515245 + 12345) % 2147483648) // 8 % 9 for j in range(9)]
        assert np.isclose(got[i], np.median(np.concatenate([v[g == k] for k in drawn])))


def test_statement_and_decision(spark):
    said = "The Committee decided to keep the target range for the federal funds rate at 2 percent. It will act."
    page = f"<p>Menu of the site with enough characters to be looked at</p><p>For release at 2:00 p.m. EST today by the board. Share</p><p>{said}</p><p>Voting for the action were all of the members of the board.</p><p>{said}</p>"
    got = {r.html: r for r in M.statement(spark.createDataFrame([(page,), ("",), ("<p>short</p>",)], "html string"), "html").collect()}
    assert got[page].statement == said and got[page].decision == said.split(". ")[0] + "." and got[""].statement == got["<p>short</p>"].decision == ""


def test_wikitext_and_drivers(spark):
    raw = "{{Infobox|{{x|{{y}}}}}}'''Oil''' is a [[Liquid|liquid]]<ref>no</ref> of [[trade]]. <!-- c --> [[File:a.png|b]] [https://x.y z]"
    assert one(spark, L.wikitext(F.col("t")), t=raw) == "Oil is a liquid of trade. z"
    text = "x Results of Operations Net sales rose 5 percent due to strong demand abroad. net SALES rose 5 percent due to strong demand abroad. Revenue fell."
    assert one(spark, L.drivers(F.col("t")), t=text) == "Net sales rose 5 percent due to strong demand abroad."


def test_stricter_gates(spark):
    labelled = {2021: 365.8, 2022: 394.3}
    assert one(spark, F.size(L.year_value_errors(F.col("t"), labelled)), t="Sales were $394.3 billion in 2021.") == 1
    assert one(spark, F.size(L.year_value_errors(F.col("t"), labelled)), t="Sales were $394.3 billion in 2022, 12 in 2021.") == 0
    assert one(spark, L.rich_leak(F.col("t")), t="Bitcoin surged after the vote") and one(spark, L.rich_leak(F.col("t")), t="it is above $4,000 now")
    assert not one(spark, L.rich_leak(F.col("t")), t="The team rose early. " + "x" * 60 + " market")
    shown = {1.5: "1.5", 123456.789: "123457", 1234567.0: "1.23457e+06", 0.00012345678: "0.000123457", 0.0000123: "1.23e-05", -2.0: "-2"}
    assert all(one(spark, S.general(F.col("x")), x=v) == t for v, t in shown.items())


def test_stub_never_makes_a_forecast_up():
    with pytest.raises(NotImplementedError):
        probe.TextForecasterStub().predict(None, None, 5)


def test_sink_keeps_an_output(spark, tmp_path):
    """A write that fails leaves the old output as it was."""
    from pairlake.sources import files

    out = f"file://{tmp_path}/out"
    files.write_json_lines(spark.range(3), out)
    with pytest.raises(Exception, match="no"):
        files.write_json_lines(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), out)
    assert spark.read.json(files.current(spark, out)).count() == 3
    with pytest.raises(ValueError):
        files.cached_years(spark, str(tmp_path / "empty"), "a int") if (tmp_path / "empty").mkdir() is None else None


def test_cached_answers_fail_open(spark):
    """Numbers may follow in any order and mark; numbers without a title, no answer, no yes and no parse keep all or nothing more."""
    from pairlake.operators import retrieve as R

    answers = {"mixed": "2) yes\n1: no, 3 . Relevant 9: yes", "none": "1: no\n2: irrelevant 3. no", "odd": "I can't say", "huge": "99999999999999: yes 12: yes 1. yes", "absent": None, "null": None}
    cases = spark.createDataFrame([(k, ["a", "b", None] if k == "null" else ["a", "b", "c"]) for k in answers], "topic string, titles array<string>")
    cache = cases.where("topic not in ('absent', 'null')").select(R.verdict_key(F.col("topic"), F.col("titles")).alias("key"), "topic")
    said = spark.createDataFrame([(k, v) for k, v in answers.items() if v], "topic string, answer string")
    got = {r.topic: (r.kept, r.fail_open) for r in R.semantic_ranked(cases, cache.join(said, "topic").drop("topic"), "topic").collect()}
    every = ([1, 2, 3], True)
    assert got == {"mixed": ([2, 3], False), "none": every, "odd": every, "huge": ([1], False), "absent": every, "null": every}
    assert R.semantic_ranked(cases.limit(0), cache.select("key", F.lit("").alias("answer")), "topic").count() == 0


def test_one_answer_of_several(spark):
    """A key with several cached answers has the smallest, rows with one key each get it, others none."""
    from pairlake.operators import emit as M

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, key string")
    cache = spark.createDataFrame([("a", "y"), ("a", "x"), ("c", "z"), (None, "n")], "key string, answer string")
    assert {r.id: r.answer for r in M.completed(rows, "key", cache).collect()} == {1: "x", 2: "x", 3: None, 4: None}
