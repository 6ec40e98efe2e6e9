"""Intermediate tables in the folder shared by driver and executors."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="stintbook-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _own_dir()


@functools.cache
def _run_dir(shared: str, application: str) -> str:
    """One folder per application, removed when the driver's Python ends."""
    path = f"{shared.rstrip('/')}/stintbook-{application}"
    session = SparkSession.getActiveSession()
    # Held now, because the session may be stopped by then.
    jvm, conf = session._jvm, session._jsc.hadoopConfiguration()
    atexit.register(_remove, jvm, conf, path)
    return path


def _remove(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone, then the folder's owner has to do it
        pass


def release(spark: SparkSession) -> None:
    """Remove what ``keep`` has written so far. For long sessions, between two queries."""
    path = _run_dir(shared_dir(spark), spark.sparkContext.applicationId)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing was written to yet, in the folder that ``release`` removes."""
    run = _run_dir(shared_dir(spark), spark.sparkContext.applicationId)
    return f"{run}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _packed() -> str:
    """This package as a zip file."""
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='stintbook-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. Without it, they need the
    package on their own path."""
    sent = any(f.endswith(f"/{Path(_packed()).name}") for f in spark.sparkContext.listFiles)
    if not sent:
        spark.sparkContext.addPyFile(_packed())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table.

    For results that several later steps read. It cuts the lineage, outlives lost executors,
    and lets each reader prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``keep``, in buckets by ``key``, so that later joins on it don't move these rows.

    The files lie in the same folder. The catalog is needed only to note the buckets, so its entry
    is dropped at once; the files of such a table stay.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .format("parquet")
        .option("path", path)
        .option("compression", "zstd")
        .saveAsTable(table)
    )
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return written
