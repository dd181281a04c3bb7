"""Working tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Only where that setting is missing (tests on one machine) a
temporary folder is made and set.  A table written and read again cuts the lineage of an iterative job, and a lost
executor takes nothing with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if kept:
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = tempfile.mkdtemp(prefix="citeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_left: set[str] = set()


def _leave_none(spark: SparkSession, path: str) -> None:
    """Delete at the application's end what its last readers needed until then."""

    def clean() -> None:
        try:
            jvm = spark._jvm
            for left in sorted(_left):
                where = jvm.org.apache.hadoop.fs.Path(left)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing can be done then
            pass

    if not _left:
        atexit.register(clean)
    _left.add(path)


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted at the application's end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _leave_none(spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def stash_bucketed(df: DataFrame, name: str, *keys: str, spread: bool = True) -> DataFrame:
    """``df`` as a table of the shared folder in as many buckets of ``keys`` as shuffles have partitions, so that joins and
    aggregates on the keys read it without an exchange.  ``spread=False``: the rows are partitioned by the keys already."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    _leave_none(spark, path)
    (df.repartition(n, *keys) if spread else df).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    back = spark.table(table)
    back._stash_path, back._stash_table = path, table
    return back


def stashed_union(frames: list[DataFrame]) -> DataFrame:
    """Stashed frames of one schema as one scan, however many they are."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[df._stash_path for df in frames])


def drop_stash(*frames: DataFrame) -> None:
    """Delete the folders of stashed frames that no later plan reads, and let Spark clean up shuffles that nobody holds."""
    for df in frames:
        if table := getattr(df, "_stash_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            _left.discard(path)
