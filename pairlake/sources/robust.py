"""A data source for JSON files of any make: an object a line, one array, or objects one after another over many lines.

Files are split by byte ranges, also where some of their lines can't be read. A record's block begins with a line that
starts as the file's first object does, with as much before its brace; a range reads the blocks that begin in it.
What can't be read costs its line, and reading goes on with the next one. A file without such lines, as an array on one
line, is one range, read piece by piece.
"""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "pairlake_json"
SCHEMA = "file string, pos long, record string, corrupt string"
#: Bytes of a range, of what is looked at to see a file's make, of a piece, and of a record at most; rows that go out at once.
RANGE, HEAD, PIECE, RECORD, ROWS = 32 << 20, 1 << 16, 1 << 20, 256 << 20, 2_000
#: What may stand between records.
BETWEEN = re.compile(r"[\s,\[\]]*")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    indent: bytes | None


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; Spark writes file:/ where others write file:///."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def make_of(head: bytes) -> bytes | None:
    """What stands before the brace of lines that begin a record; None if no line does, as far as one sees."""
    head = head.removeprefix(b"\xef\xbb\xbf")
    for line in head.split(b"\n")[:-1]:
        found = re.match(rb"[ \t]*(?=\{)", line)
        if found:
            return found[0]
    return b"" if b"\n" not in head and re.match(rb"\s*\{", head) else None


class Reading:
    """The records of text that comes in pieces: (record, corrupt), one of both."""

    def __init__(self):
        self.text = ""
        self.decoder = json.JSONDecoder()

    def take(self, final: bool) -> Iterator[tuple[str | None, str | None]]:
        """What can be read of the text so far; unless final, what may be the start of a record stays."""
        text, at = self.text, 0
        while True:
            at = BETWEEN.match(text, at).end()
            if at == len(text):
                break
            try:
                value, end = self.decoder.raw_decode(text, at)
                # a number may go on in the next piece
                if not final and end == len(text) and not isinstance(value, (dict, list, str)):
                    break
                yield (json.dumps(value, ensure_ascii=False, sort_keys=True), None) if isinstance(value, dict) else (None, text[at:end])
                at = end
            except (ValueError, RecursionError):
                if not final and len(text) - at < RECORD:
                    break
                end = text.find("\n", at)
                if end < 0 and (brace := text.find("{", at + 1)) >= 0 and not final:
                    end = brace
                end = len(text) if end < 0 else end
                yield None, text[at:end].strip()
                at = end
        self.text = text[at:]


def blocks(f, part: Range) -> Iterator[tuple[int, bytes, bool]]:
    """(place, piece, whether a block begins with it) of the lines of a range, long lines in pieces."""
    starts = None if part.indent is None else part.indent + b"{"
    f.seek(max(0, part.start - 1))
    at = part.start
    if part.start:
        at = part.start - 1
        while not (piece := f.readline(PIECE)).endswith(b"\n"):  # the line of the byte before isn't ours
            if not piece:
                return
            at += len(piece)
        at += len(piece)
    inside, fresh = part.start == 0, True
    while piece := f.readline(PIECE):
        begins = fresh and starts is not None and piece.startswith(starts)
        if begins and at >= part.end:
            return
        inside = inside or begins
        if inside:
            yield at, piece, begins
        at += len(piece)
        fresh = piece.endswith(b"\n")


class Reader(DataSourceReader):
    def __init__(self, path: str, ledgers: tuple[str, ...], size: int):
        self.path, self.ledgers, self.size = path, ledgers, size

    def files(self) -> Iterator[tuple[str, int]]:
        store, top = store_of(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        for x in sorted(found, key=lambda x: x.path):
            if x.type == fs.FileType.File and re.search(r"\.jsonl?$", x.path) and not x.path.endswith(self.ledgers):
                yield x.path, x.size

    def partitions(self) -> list[Range]:
        """Only heads of files are read here."""
        store, _ = store_of(self.path)
        out = []
        for file, size in self.files():
            with store.open_input_file(file) as f:
                indent = make_of(f.read(HEAD))
            step = max(1, size) if indent is None else self.size
            out += [Range(file, at, min(size, at + step), indent) for at in range(0, size, step)]
        return out or [Range("", 0, 0, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = store_of(self.path)
        rows: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for pos, record, corrupt in self.records(store, partition):
            rows.append((partition.file, pos, record, corrupt))
            size += len(record or corrupt or "")
            if len(rows) >= ROWS or size > PIECE:
                yield sent()
                rows, size = [], 0
        if rows:
            yield sent()

    def records(self, store, partition: Range) -> Iterator[tuple[int, str | None, str | None]]:
        with store.open_input_file(partition.file) as raw:
            f, reading = io.BufferedReader(raw, PIECE), Reading()
            utf8 = codecs.getincrementaldecoder("utf-8")("replace")
            at, seen, held = partition.start, 0, 0
            for place, piece, begins in blocks(f, partition):
                if begins:
                    for found in reading.take(True):
                        yield at + seen, *found
                        seen += 1
                    at, seen, held = place, 0, 0
                reading.text += utf8.decode(piece if place else piece.removeprefix(b"\xef\xbb\xbf"))
                held += len(piece)
                if held >= 4 * PIECE:  # a long block is read as it comes
                    for found in reading.take(False):
                        yield at + seen, *found
                        seen += 1
                    held = len(reading.text) // 2 if len(reading.text) < RECORD else 0
            reading.text += utf8.decode(b"", True)
            for found in reading.take(True):
                yield at + seen, *found
                seen += 1


class RobustJson(DataSource):
    """Options: path, ledgers (endings of files left out, separated by commas), range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        ledgers = tuple(x for x in self.options.get("ledgers", "").split(",") if x)
        return Reader(self.options["path"], ledgers, int(self.options.get("range", RANGE)))


def json_records(spark: SparkSession, path: str, ledgers: tuple[str, ...] = (), size: int = RANGE) -> DataFrame:
    """file, pos (rising with the place in the file), record (JSON text of an object), corrupt (what isn't one).

    Nothing is read before an action. Records that are not objects are corrupt. Ranges look after their own size; a worker
    holds a piece and a record. Paths are those that pyarrow's file systems open.
    """
    spark.dataSource.register(RobustJson)
    return spark.read.format(FORMAT).option("ledgers", ",".join(ledgers)).option("range", size).load(path)
