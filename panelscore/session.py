"""Session settings and the durable materialisation helper shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods above 8000 bytes. Wide score expressions would run interpreted
    # as one huge method; below this limit Spark splits them into small compiled ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "panelscore", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above that a running session still accepts."""
    for key, value in SETTINGS.items():
        if key != "spark.sql.session.timeZone":
            spark.conf.set(key, value)
    return spark


_local: list[tempfile.TemporaryDirectory] = []
_scopes: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, as it stands: whether a path is shared cannot be told from its
    scheme. Unset, a temporary folder that ends with the process serves in local mode; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    _local.append(tempfile.TemporaryDirectory(prefix="panelscore-", ignore_cleanup_errors=True))
    spark.conf.set("spark.checkpoint.dir", _local[-1].name)
    return _local[-1].name


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{path} could not be renamed to {to}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A run's own folder for what ``pin`` writes inside the block; gone with all its tables when the block ends.

    For runs whose results are written elsewhere. What is pinned outside of any block stays for the application and is
    found under its id, to be removed with ``release``.
    """
    _scopes.append(f"{checkpoint_folder(spark)}/panelscore/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    try:
        yield _scopes[-1]
    finally:
        remove(spark, _scopes.pop())


def release(spark: SparkSession) -> None:
    """Remove everything this application has pinned."""
    remove(spark, f"{checkpoint_folder(spark)}/panelscore/{spark.sparkContext.applicationId}")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several branches of one plan must see bit-identical doubles (ranks, iterative
    labels) and where lineage has to be cut. A lost executor costs nothing: the result is a table
    on shared storage, and its real size lets Catalyst decide about broadcasts.
    """
    spark = df.sparkSession
    folder = _scopes[-1] if _scopes else f"{checkpoint_folder(spark)}/panelscore/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.pinned_at = path
    return table


def unpin(table: DataFrame) -> None:
    """Delete a pinned table that nothing reads any more, as a loop does with the round before last."""
    remove(table.sparkSession, table.pinned_at)
