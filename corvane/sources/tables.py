"""Table loading and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a folder of the machine serves if driver and executors are
    one process (``local[...]``); on a cluster that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not conf and known.isDefined():
        conf = known.get()
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "corvane-checkpoint")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, what: str, bucket: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back; the table goes when the session's JVM ends.

    With ``bucket`` the rows lie in ``buckets`` parts by the hash of that column, so that joins and groups on it need no
    exchange of this table. Such a table has a name in the session's catalog until it is discarded or the process ends.
    """
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{name}"
    if bucket:
        df.repartition(buckets, bucket).write.bucketBy(buckets, bucket).sortBy(bucket).option("path", path).saveAsTable(name)
    else:
        df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p.getParent())
    out = spark.table(name) if bucket else spark.read.parquet(path)
    out._written_at = path
    if bucket:
        out._written_as = name
        if spark not in _NAMED:
            _NAMED[spark] = set()
            atexit.register(_forget, spark)
        _NAMED[spark].add(name)
    return out


_NAMED: dict[SparkSession, set[str]] = {}


def _forget(spark: SparkSession) -> None:
    try:
        for name in _NAMED[spark]:
            spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has ended, and an in-memory catalog with it
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder of the shared one, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p.getParent())
    return path


def discard(df: DataFrame) -> None:
    """Remove a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_written_at", None)
    if path:
        name = getattr(df, "_written_as", None)
        if name:
            df.sparkSession.sql(f"drop table if exists {name}")
            _NAMED[df.sparkSession].discard(name)
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: one job writes the rows to the shared folder, later plans read them there."""
    return written(df, "rows")
