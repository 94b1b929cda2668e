"""The shared folder for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where that is unset in local mode, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="feedjobs-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, for results that several later steps read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote and that nothing still to be computed reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if shared_dir(spark).split(":", 1)[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Bucketed:
    """A table in buckets of a column, under a name in the catalogue."""

    name: str
    path: str
    rows: DataFrame

    def drop(self) -> None:
        """Remove it; nothing still to be computed may read it."""
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_by(df: DataFrame, key: str, label: str, buckets: int | None = None) -> Bucketed:
    """df written to the shared folder in buckets of a column, for a table that is joined by it several times: such a
    join deals out the other side only."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", new_folder(spark, label)
    df.repartition(n, key).write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return Bucketed(name, path, spark.table(name))
