"""Where intermediate results are kept: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark can open; none if it is not there."""
    place, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place and renamed."""
    place, fs = _place(spark, path)
    beside, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file; False if it is not there (any more)."""
    (place, fs), (target, _) = _place(spark, path), _place(spark, to)
    if not fs.exists(place):
        return False
    fs.mkdirs(target.getParent())
    return bool(fs.rename(place, target))
