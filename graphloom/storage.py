"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only where that is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} would each write to a disk of their own")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + os.path.abspath(_OWN["dir"])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back.

    Cuts the lineage without tying the data to one executor, fixes the rows for
    every later use, and forgets the partitioning, so that a later join deals
    both of its sides anew and adaptive execution can split a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``staged``, in buckets of ``key``: joins on it read the table as it lies, without dealing it anew.

    For the side of a loop that stays the same. As many buckets as shuffle partitions, one
    file each; ``discard`` drops it.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"graphloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/graphloom/{table}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    delete_on_exit(spark, path)
    out = spark.table(table)
    out._staged_path, out._staged_table = path, table
    return out


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_on_exit(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``staged`` wrote for tables that no plan reads any more: the superseded rounds of a loop."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            if table := getattr(df, "_staged_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            files, where = _hadoop(df.sparkSession, path)
            files.delete(where, True)
