"""Tag files as they arrive.

The taggers are stateless projections, so the batch operator is the streaming
operator.  A stream only finds the new files; each batch of them is read by the
batch reader, so a folder gives the same rows either way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlens.sources.storage import csv_header, path_exists, read_csv

Tagger = Callable[[DataFrame], DataFrame]
FILES_AT_ONCE = 256  # files of one batch; their names pass the driver
BATCH = "batch_id"


def new_files(spark: SparkSession, folder: str, *,
              files_at_once: int = FILES_AT_ONCE) -> DataFrame:
    """``path`` of each file that arrives in the folder; its content is not read."""
    return spark.readStream.format("binaryFile") \
        .schema("path string, modificationTime timestamp, length long, content binary") \
        .option("maxFilesPerTrigger", files_at_once).load(folder).select("path")


def read_files(spark: SparkSession, paths: Sequence[str], schema: StructType,
               file_format: str = "csv") -> DataFrame:
    """Some files as the batch readers read them.

    CSV files are read together if their headers are equal; files with other headers are
    read on their own, so a column is found by its name in each of them.
    """
    if file_format != "csv":
        return spark.read.schema(schema).format(file_format).load(list(paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(csv_header(spark, path, multiLine=True)), []).append(path)
    parts = [read_csv(spark, group, schema) for header, group in sorted(groups.items()) if header]
    if not parts:
        return spark.createDataFrame([], schema)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def tag_stream(spark: SparkSession, folder: str, schema: StructType, tagger: Tagger, target: str,
               checkpoint: str, *, file_format: str = "csv",
               files_at_once: int = FILES_AT_ONCE) -> StreamingQuery:
    """Tag every file not yet processed, add the rows to ``target`` and stop.

    The checkpoint folder records which files are done; keep it on shared storage next to
    the target and never without it.  A batch has its own folder in the target and replaces
    it, so a batch that is run again after a failure gives its rows once.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(row["path"] for row in batch.collect())
        tagger(read_files(batch.sparkSession, paths, schema, file_format)) \
            .write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    return (
        new_files(spark, folder, files_at_once=files_at_once).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_tagged_stream(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All rows tagged so far, without the number of their batch; empty before the first."""
    if not path_exists(spark, target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target).select(
        *[F.col(f"`{f.name}`") for f in schema.fields])
