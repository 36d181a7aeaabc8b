"""Tables written to the shared checkpoint folder between steps, and removed when they are done with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from slopewise.session import scratch_path

BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS, elements: Column | None = None) -> DataFrame:
    """A table of a few short columns, marked for broadcast if its counted rows are at most `most`; else left to Spark.

    `elements`: how many a row's list has; rows and elements are counted then.
    """
    count = df.count() if elements is None else df.agg(F.count("*") + F.coalesce(F.sum(elements), F.lit(0))).first()[0]
    return F.broadcast(df) if count <= most else df


class Scratch:
    """Intermediate tables of one operator. Each is read back with the schema it was written with."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no later result reads."""
        jvm = self.spark._jvm
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                df._scratch_path = None
