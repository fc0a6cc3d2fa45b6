"""What the operators share: reading tables, and cutting lineage with written tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The five (lower bound) and eight ASCII white space characters that part words.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


#: Bytes of an Arrow batch that Spark sends to Python: a long text is a batch of its own, whatever its size.
BATCH_BYTES = "2m"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, and bounds Arrow batches by bytes unless the session does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if not getattr(context, "pairlake_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="pairlake-")) / "pairlake.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        context.pairlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pairlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairlake/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pairlake_path = path
    return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made of one doesn't fill a worker's memory.

    Spark bounds them by bytes (BATCH_BYTES). Memory that was freed goes back to the system now and then.
    """
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            seen += 1
            if seen % 16 == 0:
                give_back()
    give_back()


def give_back() -> None:
    """Returns freed memory of Arrow and of malloc to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.pairlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
