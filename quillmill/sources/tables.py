"""Table scans: typed Parquet, so that filters and column selection reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_stored_order(frame: DataFrame, at: str = "at") -> DataFrame:
    """With a column of each row's place in its table, (file, row), straight from the scan: what comes first of equals by all else."""
    return frame.withColumn(at, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def dealt(frame: DataFrame) -> DataFrame:
    """For costly work on each row: a table too small to have a split for each core (one row group, say) is dealt over all cores first.
    A larger one, by Catalyst's estimate of its size, has enough splits and stays as it is, without an exchange."""
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if size < cores * split else frame
