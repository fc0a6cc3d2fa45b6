"""The as-of lookup as a stream gives the batch answers, whatever the order; late rows are counted. Files by name and their digests."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from pairlake.sources import files
from pairlake.streaming import asof

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, t timestamp, kind int, id long"


def made(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "hot", "hot"]), START + dt.timedelta(hours=r.randrange(200)), r.randrange(2), i) for i in range(n)]


def batch(rows):
    out = {}
    for key, t, kind, i in rows:
        if kind == 1:
            best = max(((u, j) for k, u, kd, j in rows if k == key and kd == 0 and u < t), default=(None, None))
            out[i] = best[1]
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def found(spark, path):
    rows = spark.read.schema(asof.FOUND).parquet(path).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.report_id for r in rows}


def test_shuffled_files_like_batch(spark, tmp_path):
    """Reports that come after the events they answer, equal times, a hot key, a key without reports."""
    rows = [*made(400, 1), ("none", START, 1, 1000)]
    source, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "at"))
    for i in range(5):
        write(spark, rows[i::5], source)
    query = asof.over_files(spark, source, out, at, "1000 hours")
    assert asof.late(query) == 0
    asof.end(spark, source)
    asof.over_files(spark, source, out, at, "1000 hours")
    assert found(spark, out) == batch(rows)


def test_late_rows_are_counted(spark, tmp_path):
    """Answers come when the watermark has passed; what comes behind it is dropped and counted, and changes no answer."""
    early = [("a", START, 0, 1), ("a", START + dt.timedelta(hours=1), 1, 2), ("a", START + dt.timedelta(hours=90), 0, 3)]
    late = [("a", START + dt.timedelta(minutes=30), 0, 4), ("a", START + dt.timedelta(hours=91), 1, 5)]
    source, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "at"))
    write(spark, early, source)
    asof.over_files(spark, source, out, at, "10 hours")
    assert found(spark, out) == {2: 1}
    write(spark, late, source)
    query = asof.over_files(spark, source, out, at, "10 hours")
    assert asof.late(query) == 1
    asof.end(spark, source)
    asof.over_files(spark, source, out, at, "10 hours")
    assert found(spark, out) == {2: 1, 5: 3}


def test_files_by_name(spark, tmp_path):
    """Each name's lines in order in one file, written by tasks; digests are of the files' bytes."""
    rows = [("hot" if i % 10 else f"k{i % 30}", i, f"línea {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, id long, text string").repartition(7)
    top = f"file://{tmp_path}/by"
    got = {r.file: r.lines for r in files.write_files(df, "name", "id", F.col("text"), top, ".jsonl").collect()}
    digests = {r.file.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in files.file_digests(spark, top).collect()}
    for name in {r[0] for r in rows}:
        want = "".join(f"{t}\n" for _, _, t in sorted((r for r in rows if r[0] == name), key=lambda r: r[1])).encode()
        assert (tmp_path / "by" / f"{name}.jsonl").read_bytes() == want
        assert digests[f"{name}.jsonl"] == (len(want), hashlib.sha256(want).hexdigest()) and got[f"{name}.jsonl"] == want.count(b"\n")
    assert len(list((tmp_path / "by").iterdir())) == len(got) == len(digests)
    assert files.write_files(df.limit(0), "name", "id", F.col("text"), f"{top}2", ".x").count() == 0
