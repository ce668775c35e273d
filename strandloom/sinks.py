"""Writing tables and files: staged, sharded, with checks before and checksums after."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.text_files import check_unique, gate


def staged_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write to a staging folder beside ``path`` and rename; an existing ``path`` is never overwritten."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staging, partitionBy=partition_by)
    if not system.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"{staging} could not become {path}")


def write_fasta(df: DataFrame, path: str, key: str = "id", sequence: str = "seq", width: int = 80, unique: bool = True) -> None:
    """FASTA files, one a partition, sequences wrapped; a null or empty id or sequence fails, and, unless told otherwise, an id that stands twice."""
    if unique:
        check_unique(df, key)
    rows = gate(df.select(F.col(key).cast("string").alias("k"), F.col(sequence).alias("s")), "coalesce(k, '') = '' or coalesce(s, '') = ''", "a record without id or sequence")
    wrapped = F.regexp_replace("s", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("k"), F.lit("\n"), wrapped)).write.text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """JSON arrays, one file a partition, one element a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [("[" if first and i == 0 else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
            first = first and not lines
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)


def write_sharded_json(df: DataFrame, path: str, by: list[str], shards: int | None = None) -> None:
    """JSON lines in folders by ``by``; each folder is written by few tasks, spread by content where it is large.

    Where the last of ``by`` numbers ``shards``, shards without rows get an empty folder beside the others.
    """
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.partitionBy(*by).json(path)
    if shards is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path
    system = where(path).getFileSystem(conf)
    above = [f.getPath().toString() for f in system.globStatus(where("/".join([path, *[f"{c}=*" for c in by[:-1]]])))] if len(by) > 1 else [path]
    for folder in above:
        for k in range(shards):
            system.mkdirs(where(f"{folder}/{by[-1]}={k}"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of each file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
