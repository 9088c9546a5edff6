"""Tables that iterative operators write to the shared folder, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where it is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


class Written:
    """The folders of one operator's run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        """`df` written and read back."""
        path = shared_folder(self.spark)
        df.write.parquet(path)
        self.folders.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        """`df` as a table that stays, the others removed."""
        out = self.table(df)
        for path in self.folders[:-1]:
            remove(self.spark, path)
        return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, where the session can reach its file system."""
    if getattr(spark, "_jvm", None) is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
