"""What the corpus operators share: tables, the shared folder, and slicing of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the one set for checkpoints.

    Only where neither is set and all runs on one machine, as in local tests, it is a temporary folder.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='rowloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as objects of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: computed once, lineage cut.

    The files survive the loss of any executor, and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name like ``name`` that isn't among ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Intermediate tables of one operator, in a folder of their own that goes when the operator is done.

    with Scratch(spark, name) as scratch: ... scratch.write(df, what) ...
    What is returned from the block must not read from it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/rowloom-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def drop(self) -> None:
        at, files = _folder(self.spark, self.path)
        files.delete(at, True)

    def drop_at_end(self) -> None:
        """When the driver ends."""
        at, files = _folder(self.spark, self.path)
        files.deleteOnExit(at)

    def __exit__(self, *_: object) -> None:
        self.drop()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone.

    When the last is done, memory that the worker has freed goes back to the system, as workers wait for further tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum(np.cumsum(size) - 1, 0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def filled(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with '' for null."""
    return pc.fill_null(batch.column(column), "")


def pieces(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a list array, also of one that is a slice."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return off - off[0], lists.values.slice(int(off[0]), int(off[-1] - off[0]))
