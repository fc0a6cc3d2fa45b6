"""Scans and sinks of files. Paths go through Spark's readers, so any store that Spark knows works."""

from __future__ import annotations

import hashlib
import html
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .robust import PIECE, store_of

#: Endings of files that are ledgers, not records.
LEDGERS = (".rejected.jsonl", ".unsupported.jsonl", ".filtered.jsonl")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where all run on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="pairlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/pairlake/{name}-{uuid.uuid4().hex}"


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON object a line, of the newest version where there are several; lines that aren't one have the text in _corrupt if the schema names it."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(current(spark, path))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, record (text), corrupt of files below a path, without ledgers, that hold JSON lines, one array, or objects one after another."""
    from . import robust

    return robust.json_records(spark, path, LEDGERS)


def find_files(spark: SparkSession, path: str) -> DataFrame:
    """file: all JSON files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file")).where(F.col("file").rlike(r"\.jsonl?$"))


def discover_files(spark: SparkSession, path: str) -> DataFrame:
    """The same without ledgers."""
    files = find_files(spark, path)
    for end in LEDGERS:
        files = files.where(~F.endswith("file", F.lit(end)))
    return files


def price_csv(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """date, value of rows whose first field starts with a year and whose second is a number, not "."; keys: folders such as series_id=x."""
    raw = spark.read.option("header", "true").csv(path, schema="date string, value string")
    kept = raw.where(F.col("date").rlike(r"^\d{4}") & ~F.trim("value").isin("", "."))
    return kept.select(*keys, "date", F.col("value").cast("double").alias("value"))


def yields_xml(spark: SparkSession, path: str) -> DataFrame:
    """date, two_year, ten_year of entries that have all three, once each, in order."""
    raw = spark.read.format("xml").option("rowTag", "m:properties").schema("`d:NEW_DATE` string, `d:BC_2YEAR` double, `d:BC_10YEAR` double").load(path)
    rows = raw.select(F.substring("`d:NEW_DATE`", 1, 10).alias("date"), F.col("`d:BC_2YEAR`").alias("two_year"), F.col("`d:BC_10YEAR`").alias("ten_year"))
    return rows.dropna().dropDuplicates().orderBy("date")


def epss_csv(spark: SparkSession, path: str, day: str, targets: DataFrame) -> DataFrame:
    """cve, score of a daily snapshot whose first line names the day; only targets (cve)."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("#"))).where(F.contains("value", F.lit(f"score_date:{day}")))
    if not head.head(1):
        raise ValueError(f"no snapshot of {day} in {path}")
    rows = lines.where(~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("cve,")))
    part = F.split("value", ",")
    return rows.select(part[0].alias("cve"), F.round(part[1].cast("double") * 100, 2).alias("score")).join(targets, "cve", "left_semi")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of the files below a path, read piece by piece where the tasks are; only their names are listed before."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for name in batch[0].to_pylist():
                store, at = store_of(name)
                h, n = hashlib.sha256(), 0
                with store.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                        n += len(piece)
                out[0].append(n)
                out[1].append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out[0], pa.int64()), pa.array(out[1])], names=["file", "bytes", "sha256"])

    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(digest, "file string, bytes long, sha256 string")


def write_files(rows: DataFrame, name: str, order: str, line: Column, folder: str, ending: str) -> DataFrame:
    """Writes a file (its name and ending) for each name with its lines in order; returns file and lines of each, after writing.

    The rows of a name are sorted within one task, which writes them as they come and moves the file in place when it is
    whole, so a task that is run again does no harm. A name is a file, so its writer is one task.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(name).alias("name"), F.col(order).alias("order"), line.alias("line"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(folder)
        store.create_dir(top)
        now, out, aside, n = None, None, "", 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(aside, f"{top}/{now}{ending}")
                done.append((f"{now}{ending}", n))

        for batch in batches:
            names, lines = batch[0].to_pylist(), batch[2].to_pylist()
            for x, text in zip(names, lines):
                if x != now:
                    close()
                    now, n, aside = x, 0, f"{top}/.{x}{ending}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(aside)
                out.write(text.encode() + b"\n")
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "lines"])

    sorted_ = slim.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name", "order")
    ledger = scratch(spark, "written")
    sorted_.mapInArrow(write, "file string, lines long").write.parquet(ledger)
    return spark.read.schema("file string, lines long").parquet(ledger)


def _replace(spark: SparkSession, aside: str, path: str) -> None:
    """A finished file takes the place of the one at its path in one step: there is no moment without either."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    new, to = (jvm.org.apache.hadoop.fs.Path(x) for x in (aside, path))
    store = to.getFileSystem(conf)
    if store.getUri().getScheme() == "file":
        move = jvm.java.nio.file.StandardCopyOption
        how = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 2)
        how[0], how[1] = move.ATOMIC_MOVE, move.REPLACE_EXISTING
        at = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
        jvm.java.nio.file.Files.move(at(new), at(to), how)
    else:
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(new, to, how)


#: Folder of manifests in a versioned output: files named by number, each with the name of a version's folder.
MANIFESTS = "_manifests"


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version's folder) of an output's manifests, in order."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFESTS}")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top):
        return []
    names = [x.getPath().getName() for x in store.listStatus(top)]
    return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names) if n.isdigit() and v)


def current(spark: SparkSession, path: str) -> str:
    """The folder of a versioned output's newest version; the path itself where there are no versions."""
    found = _manifests(spark, path)
    return f"{path.rstrip('/')}/{found[-1][1]}" if found else path


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the newest by creating one empty file, which either is there or isn't; of two writers the later one wins."""
    fs = spark._jvm.org.apache.hadoop.fs
    top = fs.Path(f"{path.rstrip('/')}/{MANIFESTS}")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(top)
    number = max((n for n, _ in _manifests(spark, path)), default=0) + 1
    store.create(fs.Path(top, f"{number:012d}-{version}"), False).close()


def _swept(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes versions before the last ``keep``; readers of the one before the newest may still be at work."""
    fs = spark._jvm.org.apache.hadoop.fs
    top = fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for number, version in _manifests(spark, path)[:-keep]:
        store.delete(fs.Path(top, version), True)
        store.delete(fs.Path(top, f"{MANIFESTS}/{number:012d}-{version}"), False)


def write_json_lines(records: DataFrame, path: str, keep: int = 2) -> int:
    """Writes records as a new version below path and publishes it when it is whole; returns their number.

    Whoever reads by json_lines sees the old version or the new one, whole, whenever a writer stops. An unfinished version is never read.
    """
    from pyspark.sql import Observation

    spark, version, seen = records.sparkSession, f"v{uuid.uuid4().hex}", Observation("records")
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.json(f"{path.rstrip('/')}/{version}")
    _publish(spark, path, version)
    _swept(spark, path, keep)
    return seen.get["n"]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, put in place when it is whole."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    at = spark._jvm.org.apache.hadoop.fs.Path(aside)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _replace(spark, aside, path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as JSON with sorted keys."""
    write_text(spark, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", path)


def write_html(summaries: DataFrame, path: str) -> None:
    """A table of a summary, which has a row for each file or source."""
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = [row(summaries.columns, "th"), *(row(r, "td") for r in summaries.collect())]
    write_text(summaries.sparkSession, "<table>\n" + "\n".join(body) + "\n</table>\n", path)


def dated_csv(spark: SparkSession, path: str, date: str, *values: str) -> DataFrame:
    """date and the named columns (text) of a CSV file with a header; dates in either of two layouts, rows without one left out."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    day = F.coalesce(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), F.try_to_timestamp(date, F.lit("M/d/yyyy"))).cast("date")
    return raw.select(day.alias("date"), *values).where(F.col("date").isNotNull())


def until(series: DataFrame, due: str, least: int = 30) -> DataFrame:
    """series (series_id, date, value) up to a due date, without series of fewer than ``least`` points there."""
    rows = series.where(F.col("date") <= F.lit(due).cast("date"))
    enough = rows.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(enough, "series_id", "left_semi")


def first_record(lines: DataFrame) -> DataFrame:
    """file, record: the first line of each file (file, pos, record) that isn't blank."""
    return lines.where(F.trim("record") != "").groupBy("file").agg(F.min_by("record", "pos").alias("record"))


def registry_errors(sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, error: sources without a known status, and aliases of unknown sources."""
    known = sources.select(F.col("source").alias("known"))
    bad = sources.where(~F.coalesce(F.col("status").isin("approved", "conditional", "review_required", "blocked"), F.lit(False))).select(F.col("source").alias("name"), F.lit("status").alias("error"))
    lost = aliases.join(known, aliases["source"] == known["known"], "left_anti").select(F.col("alias").alias("name"), F.lit("alias").alias("error"))
    return bad.union(lost)


def snapshots_window(targets: DataFrame, snapshots: DataFrame, before: int = 21, after: int = 8, least: int = 10) -> DataFrame:
    """id, added, n, values: of each target (id, added) the scores (id, day, score) of the days around it that are there, in order.

    Days are cut into spans as long as a window, so a target meets two spans of its id and is not made into a row for
    each day; neither side is broadcast, as both grow with the input.
    """
    width = before + after + 1
    span = lambda day: F.floor(F.unix_date(day) / width)
    spans = F.sequence(span(F.date_sub("added", before)), span(F.date_add("added", after)))
    windows = targets.select("id", "added", F.explode(spans).alias("span")).hint("merge")
    days = snapshots.select("id", "day", "score", span(F.col("day")).alias("span"))
    near = F.col("day").between(F.date_sub("added", before), F.date_add("added", after))
    got = windows.join(days, ["id", "span"]).where(near).groupBy("id", "added").agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("s"))  # a window's days
    return got.where(F.size("s") >= least).select("id", "added", F.size("s").alias("n"), F.transform("s", lambda x: x["score"]).alias("values"))


def cached_years(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The yearly files of a cache; raises ValueError if they have no row."""
    rows = spark.read.option("header", "true").schema(schema).csv(path)
    if rows.isEmpty():
        raise ValueError(f"no rows in the cache {path}")
    return rows
