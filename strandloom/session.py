"""Session helpers: reading tables and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``directory``."""
    return spark.read.parquet(f"{directory}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine (local tests) may name none; there a fresh temporary folder is set. On a
    cluster executors could not read each other's folders, so that fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def by_work(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as there are cores or shuffle partitions, whatever its size.

    For groups of bounded size whose work is large for their bytes: adaptive execution would put them in few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but column-wise and compressed. The files survive the loss
    of executors and are dropped when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    except Exception:  # the gateway may be gone already; the folder's owner clears it then
        pass
