"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapscore.storage import new_path, shuffles_end_with_query


class Scratch:
    """A folder of intermediate tables below ``spark.checkpoint.dir``, one for each run of an operator.

    ``keep`` writes a table and reads it back, which cuts the lineage: an executor that is lost later
    costs its tasks, not the steps before. ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_end_with_query(self.spark):
            df.select("*").write.parquet(path)  # planned anew, under the switch
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
