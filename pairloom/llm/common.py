"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and tokens of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that one Arrow batch may bring to a Python worker, unless the session says otherwise.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that a worker sends back, unless one row has more.
SENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, batch: int = 4 << 20) -> DataFrame:
    """A given table. batch: bytes of an Arrow batch, where the session has not set them."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, batch)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/pairloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, and a lost executor costs no
    recomputation of what came before. Tables lie under the application's id and may go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | F.Column, n: int) -> F.Column:
    """crc32 of the id's decimal digits modulo n: the train/held-out split of the contracts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


class Shared:
    """An object of this library as a broadcast that needs no copy of the library on executors; a worker keeps it loaded."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "_loaded" not in self.held.__dict__:
            self.held._loaded = cloudpickle.loads(self.held.value)
        return self.held._loaded

    def made(self, make: Callable):
        """make(value), once per worker. It is kept beside the value and not in it, so nothing refers in a circle and both go
        as soon as the worker drops the broadcast, not when Python next looks for circles."""
        if "_made" not in self.held.__dict__:
            self.held._made = make(self.value)
        return self.held._made

    def free(self) -> None:
        self.held.unpersist()


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow; when its task ends, the memory it has freed goes back to the system. Workers live on between
    stages, and what they held on to would add to what the next one needs. Large batches are sent in slices, since an
    executor's JVM holds each whole outside its heap."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in run(parts):
                yield from sliced(b, SENT)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def sliced(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, as slices of about limit bytes or one row each."""
    step = max(1, batch.num_rows // max(1, -(-batch.nbytes // limit)))
    for i in range(0, max(1, batch.num_rows), step):
        yield batch.slice(i, step)


def batches_of(rows: list, sizes: list[int], limit: int):
    """Consecutive runs of rows whose sizes add up to about limit, a larger row alone."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, rows[start:i]
            start, total = i, 0
        total += s
    if start < len(rows):
        yield start, rows[start:]
