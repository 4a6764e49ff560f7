"""Reading the tables and keeping intermediate results in shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session that names none (tests, notebooks) gets a temporary
    folder, which is set; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that this process wrote and that are still there.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` and ``clear_scratch`` know it."""
    _WRITTEN.append(f"{scratch_root(spark)}/memlake-{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors: the written files are
    the only state that later stages depend on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that nothing will read again."""
    for df in frames:
        path = df.__dict__.get("_scratch")
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def written() -> set[str]:
    return set(_WRITTEN)


def release_since(before: set[str], keep: DataFrame) -> None:
    """Delete what was written after ``before = written()``, but for ``keep``."""
    for path in [x for x in _WRITTEN if x not in before and x != keep.__dict__.get("_scratch")]:
        _WRITTEN.remove(path)
        _delete(keep.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this process still has in the shared folder; results not yet consumed are lost with it."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, handing freed memory back to the system when its task ends.

    Python workers outlive their tasks and wait in turn for the next ones, so
    what each of them keeps unused adds up within an executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return tidied
