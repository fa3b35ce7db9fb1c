"""Shared scratch storage and binary files that tasks write and read back.

Everything goes under ``spark.checkpoint.dir``, the folder that the driver and all executors share. Only where a
session has none (tests on one machine) is a temporary folder set.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to Python, where the session has Spark's default (64 MB), of which tasks hold several.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that leaves them at the default."""
    if spark.conf.get(_BATCH, None) in (None, "64MB", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The URI of the shared folder. Without one only a local master, whose tasks share the driver's disk, may go on."""
    small_batches(spark)
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable) -> Callable:
    """`run` over a task's Arrow batches. Python workers live on between tasks, more of them than run at a time, so what a
    worker holds in reserve goes back to the system when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return tidied


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one; it does not exist yet."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: lost executors only cost the tasks that read it."""
    shared_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def keep(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: smaller than a checkpoint, but its partitions are dealt anew."""
    at = new_folder(frame.sparkSession, "table")
    frame.write.option("compression", "zstd").parquet(at)
    return frame.sparkSession.read.schema(frame.schema).parquet(at)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of the frame has."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class AtomicFile:
    """A binary file that appears under its name only when complete, so that retried tasks do no harm.

    Each attempt writes its own name (``stem-<unique>.ext``); rows refer to the name of the attempt that succeeded.
    """

    def __init__(self, folder: str, stem: str, ext: str):
        self.system, base = open_filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}.{ext}"
        self.path = f"{base}/{self.name}"
        self.stream = self.system.open_output_stream(f"{base}/.{self.name}.part")
        self.position = 0

    def write(self, data) -> int:
        """Append; the offset at which the data starts."""
        at = self.position
        self.stream.write(data)
        self.position += len(data)
        return at

    def close(self) -> str:
        self.stream.close()
        head, _, name = self.path.rpartition("/")
        self.system.move(f"{head}/.{name}.part", self.path)
        return self.name


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)
