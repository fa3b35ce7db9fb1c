"""Lineage cuts for iterative plans, and the folder that all tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one only a local master, whose tasks share the driver's disk, may go on."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        found = found or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared one; it does not exist yet."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint: lost executors only cost the tasks that read it."""
    shared_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Rows of a batch that goes to Python, where the session has Spark's default (10,000), of which a task holds several.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts in a session that leaves them at the default."""
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _bytes_of(x, kind.elementType)) if not isinstance(kind.elementType, T.NumericType) else F.greatest(F.size(value), F.lit(0)).cast("long") * 8
        return 16 + F.coalesce(each, F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(16).cast("long")


def bounded(frame: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """With a hint to broadcast if it has no more than so many rows, which are counted, and bytes, which are summed up; otherwise as it is."""
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields), F.lit(0).cast("long"))
    n, total = frame.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(frame) if n <= rows and total <= size else frame
