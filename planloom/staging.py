"""Cutting lineage: intermediate tables written to the shared checkpoint folder.

Iterative operators write each round as a Parquet table under ``spark.checkpoint.dir`` and read it back.
A written table survives the loss of executors, and its file sizes give the optimizer true statistics,
so later joins choose broadcast or shuffle by measured size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster; on a local master a fresh one under /tmp when none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/planloom-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Removes all staged tables of this application; call it when their results have been written out."""
    remove(spark, _app_dir(spark))


class Stage:
    """A private folder for one operator run; tables are written under increasing names."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        return self.write_path(df)[0]

    def write_path(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def write_rounds(self, name: str) -> tuple[str, callable]:
        """A table that grows by one part a round: its path, and a function that writes a part and reads it back.
        ``spark.read.parquet(path)`` reads all parts, with the round in the column ``name``."""
        path = f"{self.root}/t{self.count}"
        self.count += 1

        def write(df: DataFrame, round_no: int) -> DataFrame:
            part = f"{path}/{name}={round_no}"
            df.write.parquet(part)
            return self.spark.read.schema(df.schema).parquet(part)

        return path, write

    def write_parts(self, df: DataFrame, column: str, values: list[int]) -> list[tuple[DataFrame | None, str]]:
        """Writes ``df`` once, split by an integer column; gives (table or None when empty, path) per value."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.partitionBy(column).parquet(path)
        schema = df.drop(column).schema
        out = []
        for v in values:
            part = f"{path}/{column}={v}"
            hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(part)
            there = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path)
            out.append((self.spark.read.schema(schema).parquet(part) if there else None, part))
        return out

    def drop(self, path: str | None) -> None:
        if path:
            remove(self.spark, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    return Stage(df.sparkSession, name).write(df)
