"""As-of lookups over streams: each event gets the latest report before it, whatever the order both arrive in.

An event waits in its key's state until the watermark has reached it; by then all reports before it have come, so the
answer is the one a batch would give. Of the reports a key keeps the latest before the watermark and those after it. Rows
behind the watermark are dropped by the engine, which counts them (late()).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOUND = "id long, report_at long, report_id long"
STATE = "event_at array<long>, event_id array<long>, report_at array<long>, report_id array<long>"
#: What a stream's end is told by: a row so far ahead that every event's time has come.
END = "2200-01-01"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events, reports = [], []
    if state.exists:
        a, b, c, d = state.get
        events, reports = list(zip(a, b)), list(zip(c, d))
    for frame in frames:
        for t, kind, i in zip(frame["ms"], frame["kind"], frame["id"]):
            if kind < 2:
                (events if kind else reports).append((int(t), int(i)))
    mark = state.getCurrentWatermarkMs()
    reports.sort()
    ready = [e for e in events if e[0] <= mark]
    out = []
    for t, i in ready:
        n = bisect_left(reports, (t,))
        out.append((i, *(reports[n - 1] if n else (None, None))))
    events = [e for e in events if e[0] > mark]
    reports = reports[max(0, bisect_left(reports, (mark,)) - 1) :]
    state.update(tuple(list(x) for x in (*(zip(*events) if events else ((), ())), *(zip(*reports) if reports else ((), ())))))
    if events:
        state.setTimeoutTimestamp(max(mark + 1, min(e[0] for e in events)))
    yield pd.DataFrame({"id": pd.array([o[0] for o in out], "Int64"), "report_at": pd.array([o[1] for o in out], "Int64"), "report_id": pd.array([o[2] for o in out], "Int64")})


def asof_strict(rows: DataFrame, delay: str) -> DataFrame:
    """id, report_at (milliseconds), report_id of each event: the latest report of its key strictly before it, of several at one time the greatest id.

    rows: a stream of (key, t, kind 0 for reports, 1 for events, 2 for the end, id), ``delay`` out of order at most.
    """
    keyed = rows.withWatermark("t", delay).withColumn("ms", F.unix_millis("t")).groupBy("key")
    return keyed.applyInPandasWithState(_step, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late(query: StreamingQuery) -> int:
    """Rows of a stopped query's recent batches that came behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def over_files(spark: SparkSession, source: str, out: str, checkpoint: str, delay: str, files: int = 1) -> StreamingQuery:
    """Looks up what files below source (Parquet of asof_strict's rows) newly hold, ``files`` a batch, and appends to out."""
    rows = spark.readStream.schema("key string, t timestamp, kind int, id long").option("maxFilesPerTrigger", files).parquet(source)
    query = asof_strict(rows, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def end(spark: SparkSession, source: str) -> None:
    """Adds the row that ends a stream of files."""
    spark.range(1).select(F.lit("").alias("key"), F.lit(END).cast("timestamp").alias("t"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("id")).write.mode("append").parquet(source)
