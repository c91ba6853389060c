"""Data of the caller's as tables of observations, and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def from_arrays(spark: SparkSession, columns: Mapping[str, Sequence], schema: str | None = None) -> DataFrame:
    """Parallel sequences as columns, observations numbered from 1; their lengths must agree."""
    sizes = {k: len(v) for k, v in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"lengths differ: {sizes}")
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values()), 1)]
    return spark.createDataFrame(rows, f"_obs long, {schema}" if schema else ["_obs", *columns])


def from_rows(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """Tuples as observations, numbered from 1."""
    return spark.createDataFrame([(i, *(r if isinstance(r, (tuple, list)) else (r,))) for i, r in enumerate(rows, 1)], f"_obs long, {schema}")


def register_container(spark: SparkSession, name: str, numobs: Callable[[], int], getobs: Callable[[int], tuple], schema: str, partitions: int = 8) -> None:
    """Make ``spark.read.format(name).load()`` read a container given by its size and a function of the index, from 1.

    Executors call ``getobs`` for their range of indices; the driver calls ``numobs`` alone.
    """

    class Range(InputPartition):
        def __init__(self, start: int, stop: int) -> None:
            super().__init__(start)
            self.start, self.stop = start, stop

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            n = numobs()
            step = max(1, -(-n // partitions))
            return [Range(i, min(i + step, n + 1)) for i in range(1, n + 1, step)]

        def read(self, partition: Range):
            for i in range(partition.start, partition.stop):
                yield (i, *getobs(i))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"_obs long, {schema}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)


def write_table(data: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a table in one of Spark's file formats, in folders by the columns ``by``."""
    writer = data.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; it goes when the driver ends.

    Only where none is set and all runs on one machine it is a temporary one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='rowloom-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
