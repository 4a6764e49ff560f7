"""A store of records that a batch changes only where it meets its scopes.

Rows lie in buckets by a hash of their scope.  A batch reads the buckets that
its rows fall into, writes these anew under its own number and then a manifest
that names, for each bucket, the version that holds it.  Readers follow the
newest manifest; files of other buckets, and of older versions, stay as they
are.  A manifest comes into being by a rename, so a batch that dies halfway
leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.operators import write
from memlake.storage import checkpointed, delete, file_names, read_text, write_text

#: Buckets of a new store.
BUCKETS = 64


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in file_names(spark, f"{root}/manifests") if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version, scope, buckets, schema and ``held``: bucket to version (at most ``buckets`` entries)."""
    known = _manifests(spark, root)
    if not known:
        raise ValueError(f"no store at {root}")
    return json.loads(read_text(spark, f"{root}/manifests/{known[-1] if version is None else version}"))


def _bucket(scope: list[str], buckets: int):
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope] + [F.col(c).isNull() for c in scope]
    return F.pmod(F.xxhash64(*marks), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, info: dict) -> None:
    """Write ``rows`` as their buckets' files of version ``info["version"]``, then the manifest."""
    spark, version = rows.sparkSession, info["version"]
    path = f"{root}/rows/version={version}"
    bucketed = rows.withColumn("bucket", _bucket(info["scope"], info["buckets"]))
    # No hint on "bucket" alone: AQE may split a bucket that holds most rows into several files.
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(path)
    held = info["held"] | {n.removeprefix("bucket="): version for n in file_names(spark, path) if n.startswith("bucket=")}
    out = info | {"held": held, "schema": json.loads(rows.schema.json())}
    write_text(spark, f"{root}/manifests/{version}", json.dumps(out))


def create(rows: DataFrame, root: str, scope: list[str], buckets: int = BUCKETS) -> None:
    """A new store with these rows; their ids are unique and not null."""
    if _manifests(rows.sparkSession, root):
        raise ValueError(f"there is a store at {root}")
    _write(write.with_history(rows), root, {"version": 1, "scope": scope, "buckets": buckets, "held": {}})


def read(spark: SparkSession, root: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a version (the newest), or of some buckets of it."""
    info = manifest(spark, root, version)
    schema = StructType.fromJson(info["schema"])
    wanted = [f"{root}/rows/version={v}/bucket={b}" for b, v in sorted(info["held"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def remember(incoming: DataFrame, root: str, t: float) -> DataFrame:
    """Take a batch in (``write.remember``); returns its counts, and the store is one version further.

    Only the buckets that the batch falls into are read and written, but for
    one pass over the ``id`` column: an id that any stored row has, whatever
    its scope, is taken.  A batch that writes and merges nothing makes no
    version.  New columns of a batch are added, null for the rows before.
    """
    spark, info = incoming.sparkSession, manifest(incoming.sparkSession, root)
    sound, failed = write.sound_rows(incoming)
    sound = checkpointed(sound)
    met = {r[0] for r in sound.select(_bucket(info["scope"], info["buckets"])).distinct().collect()}  # at most `buckets`
    existing = read(spark, root, buckets=met)
    judged = write.remember_batch(sound, existing, t, info["scope"])
    elsewhere = read(spark, root, buckets=set(range(info["buckets"])) - met).select("id").withColumn("__taken", F.lit(True))
    lost = F.col("__taken").isNotNull() & (F.col("outcome") == "new")
    outcome = checkpointed(judged.join(elsewhere, "id", "left").withColumn("outcome", F.when(lost, "clash").otherwise(F.col("outcome"))).drop("__taken"))
    if outcome.where("outcome in ('new', 'merge')").head(1):
        changed = sound.join(outcome.where("outcome in ('new', 'merge')").select("id"), "id", "left_semi")
        touched = {r[0] for r in changed.select(_bucket(info["scope"], info["buckets"])).distinct().collect()}
        after = write.after_batch(sound, read(spark, root, buckets=touched), outcome)
        _write(after, root, info | {"version": info["version"] + 1})
    return write.batch_counts(outcome, failed)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but for the newest ``keep``, and version folders that none of these names; returns how many folders went."""
    known = _manifests(spark, root)
    kept = [manifest(spark, root, v) for v in known[-keep:]]
    needed = {v for info in kept for v in info["held"].values()} | {info["version"] for info in kept}
    for v in known[:-keep]:
        delete(spark, f"{root}/manifests/{v}")
    old = [n for n in file_names(spark, f"{root}/rows") if n.startswith("version=") and int(n.removeprefix("version=")) not in needed]
    for n in old:
        delete(spark, f"{root}/rows/{n}")
    return len(old)
