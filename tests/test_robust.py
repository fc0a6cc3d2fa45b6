"""Robust JSON: every make of file gives its records, whole and in ranges of any size."""

import json
import random
import resource

import pytest

from pairlake.sources import robust

r = random.Random(4)
RECORDS = [{"id": i, "text": r.choice(["plain", 'say "hi" {[,', "back\\slash", "line\nbreak", "é中😀", "}{", ""]) * r.randrange(4), "in": [{"x": i}, {"y": [1, {}]}]} for i in range(60)]


def text_of(make):
    """(text of a file, what can't be read in it)."""
    one = lambda x: json.dumps(x, ensure_ascii=False)
    pretty = lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    return {
        "lines": ("\n".join(map(one, RECORDS)) + "\n", []),
        "blank lines": ("\n\n" + "\n \r\n".join(map(one, RECORDS)), []),
        "broken lines": ("\n".join(one(x) + ("\nnot json" if x["id"] % 7 == 0 else "") for x in RECORDS) + '\n{"id": 5, "te', ["not json"] * 9 + ['{"id": 5, "te']),
        "broken first": ("# head\n" + "\n".join(map(one, RECORDS)), ["# head"]),
        "broken brace": ('{"a": [\n' + "\n".join(map(one, RECORDS)), ['{"a": [']),
        "two on a line": ("\n".join(one(a) + one(b) for a, b in zip(RECORDS[::2], RECORDS[1::2])), []),
        "pretty": ("\n".join(map(pretty, RECORDS)), []),
        "pretty in lines": ("\n".join((pretty if x["id"] % 5 == 3 else one)(x) for x in RECORDS), []),
        "array": (json.dumps(RECORDS, indent=2, ensure_ascii=False), []),
        "array in lines": ("[\n" + ",\n".join(map(one, RECORDS)) + "\n]\n", []),
        "array on a line": (one(RECORDS), []),
        "not objects": ("\n".join(map(one, RECORDS)) + '\n3\n"s"\nnull\n', ["3", '"s"', "null"]),
        "mark": ("﻿" + "\n".join(map(one, RECORDS)), []),
    }[make]


MAKES = "lines,blank lines,broken lines,broken first,broken brace,two on a line,pretty,pretty in lines,array,array in lines,array on a line,not objects,mark".split(",")


@pytest.mark.parametrize("make", MAKES)
def test_every_make_in_ranges(tmp_path, make):
    """Each record once, in order, whatever the size of ranges, also of single bytes; what can't be read is kept."""
    text, bad = text_of(make)
    (tmp_path / "a.jsonl").write_text(text, encoding="utf-8")
    for size in (1, 37, 400, 10**6):
        reader = robust.Reader(str(tmp_path), (), size)
        parts = reader.partitions()
        assert len(parts) == 1 or size < 10**6
        rows = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
        assert [json.loads(x["record"]) for x in rows if x["record"]] == RECORDS
        assert [x["corrupt"] for x in rows if x["record"] is None] == bad
        pos = [x["pos"] for x in rows]
        assert pos == sorted(set(pos))


def test_one_bad_line_stays_split(spark, tmp_path, monkeypatch):
    """A file with a bad line is read in many tasks, and nothing runs before an action."""
    lines = [json.dumps({"id": i, "pad": "x" * 90}) for i in range(3000)]
    lines[1234] = "not json"
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "a.rejected.jsonl").write_text('{"id": -1}\n')
    (tmp_path / "b.json").write_text("")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    df = robust.json_records(spark, str(tmp_path), (".rejected.jsonl",), 20_000)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    assert {json.loads(x.record)["id"] for x in rows if x.record} == set(range(3000)) - {1234} and [x.corrupt for x in rows if x.record is None] == ["not json"]
    (tmp_path / "none").mkdir()
    assert robust.json_records(spark, str(tmp_path / "none")).count() == 0


def test_long_array_needs_little_memory(tmp_path):
    """An array of 200 MB on one line is read with a few pieces in memory."""
    with (tmp_path / "a.json").open("w") as f:
        f.write("[")
        for i in range(2000):
            f.write(("," if i else "") + json.dumps({"id": i, "pad": "x" * 100_000}))
        f.write("]")
    reader = robust.Reader(str(tmp_path), (), robust.RANGE)
    (part,) = reader.partitions()
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for b in reader.read(part):
        n += b.num_rows
    assert n == 2000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000
