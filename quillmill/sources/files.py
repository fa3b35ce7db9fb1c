"""File scans and sinks: directories, plain text of any encoding, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import nfc
from quillmill.plans.checkpoints import cut, scratch  # noqa: F401

# What reads a file of which ending. Old word files are refused.
ROUTES = {"txt": "plain", "md": "plain", "docx": "docx", "pdf": "pdf", "hwp": "hwp", "hwpx": "hwp", "parquet": "table", "jsonl": "lines"}


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def route_of(name: Column) -> Column:
    """The reader of a file by its ending; null if there is none."""
    found = F.lit(None).cast("string")
    for ending, reader in ROUTES.items():
        found = F.when(extension(name) == ending, reader).otherwise(found)
    return found


def scan_directory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder: composed name, size and reader; hidden files left out, names that are the same once composed kept once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    named = files.withColumn("name", nfc(F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))))
    return named.filter(~F.col("name").startswith(".")).groupBy("name").agg(F.min("path").alias("path"), F.min("length").alias("size")).withColumn("reader", route_of(F.col("name")))


def listed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files in a folder and the folders below it, but for names that begin with a dot or an underscore.

    One folder is one row of a task, level by level, so that the driver sees only how many folders a level has; files in
    many folders are listed by many tasks.
    """
    from fnmatch import fnmatchcase

    from quillmill.sources.docx import _open

    schema = "path string, length long, modified long, folder boolean"

    def look(batches):
        import pyarrow as pa
        from pyarrow import fs

        kind = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])
        for batch in batches:
            for at in batch["path"].to_pylist():
                system, base = _open(folder)
                found = [f for f in system.get_file_info(fs.FileSelector(base + at)) if not f.base_name.startswith((".", "_")) and (not f.is_file or fnmatchcase(f.base_name, glob))]
                for i in range(0, len(found), 4096):
                    part = found[i : i + 4096]
                    yield pa.RecordBatch.from_pylist([{"path": f"{at}/{f.base_name}", "length": f.size if f.is_file else 0, "modified": (f.mtime_ns or 0) // 1000, "folder": not f.is_file} for f in part], kind)

    level, files = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = cut(level.mapInArrow(look, schema))
        files.append(found.filter("NOT folder"))
        folders = found.filter("folder").select("path")
        n = folders.count()
        if not n:
            break
        level = folders.repartition(min(n, 8 * spark.sparkContext.defaultParallelism), "path")
    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    return every.select("path", "length", F.timestamp_micros("modified").alias("modificationTime"))


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, size, modified) of the files below a folder by composed name, from the listing alone: no file is opened. Files whose
    names begin with a dot or an underscore aren't listed; of names that are the same once composed the latest file counts."""
    named = listed_files(spark, folder, glob).withColumn("name", nfc(F.substring_index("path", "/", -1)))
    return named.groupBy("name").agg(F.max_by("length", F.struct("modificationTime", "path")).alias("size"), F.max("modificationTime").alias("modified"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change, size) of each file in either manifest: added, removed, modified by time or size, or same. An index of `before` is
    stale if anything isn't the same."""
    old = before.select("name", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    both = after.join(old, "name", "full")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
    change = F.when(F.col("old_modified").isNull(), "added").when(F.col("modified").isNull(), "removed").when(same, "same").otherwise("modified")
    return both.select("name", change.alias("change"), F.coalesce("size", "old_size").alias("size"))


def write_files(rows: DataFrame, folder: str) -> int:
    """A file for each row (name, content) below the folder, in place of one that has the name; their number. A name may have folders
    before it. A file appears when whole."""
    from quillmill.sources.docx import _open

    def put(batches):
        import uuid

        import pyarrow as pa

        system, base = _open(folder)
        made = set()
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                place = f"{base}/{name}".rpartition("/")[0]
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write((content or "").encode())
                system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def write_json_lines(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").json(folder)


def read_json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; blank lines and lines that begin with # are left out."""
    lines = spark.read.text(folder).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")
