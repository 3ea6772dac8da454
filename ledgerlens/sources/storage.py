"""Read and write raw tables, tagged tables, exports and vector tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerlens import constants as K
from ledgerlens.functions.lists import parse_list
from ledgerlens.sources import schemas

CSV_READ = {"header": True, "escape": '"', "encoding": "UTF-8"}
CSV_WRITE = {"header": True, "escape": '"'}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's file system for the one name; nothing is listed."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return path_exists(spark, f"{path}/_SUCCESS")


def snapshot(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files.

    One listing per folder; the digest changes when the table is written anew.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, folders = hashlib.sha256(), [root]
    while folders:
        for status in files.listStatus(folders.pop()):
            if status.isDirectory():
                folders.append(status.getPath())
            else:
                found.update(f"{status.getPath()} {status.getLen()} "
                             f"{status.getModificationTime()}\n".encode())
    return found.hexdigest()


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    return next((p for p in paths if path_exists(spark, p)), None)


def candidates(root: str, name: str, folders: Sequence[str] = K.CANDIDATE_FOLDERS) -> list[str]:
    return ["/".join(part for part in (root.rstrip("/"), folder, name) if part)
            for folder in folders]


def _file_schema(header: Sequence[str], schema: StructType) -> StructType:
    """Schema in the order of the file; unknown columns are read as text."""
    known = {f.name: f for f in schema.fields}
    return StructType([known.get(name, StructField(name, StringType())) for name in header])


def csv_header(spark: SparkSession, path: str | Sequence[str], **options) -> list[str]:
    """The column names of a CSV file, or of the first one of a folder."""
    return spark.read.options(**{**CSV_READ, **options}).csv(path).columns


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType, *,
             multi_line: bool = True) -> DataFrame:
    """CSV with a header; columns are found by name, absent ones come out null.

    Quoted fields may hold doubled quotes and line breaks.  Files without line breaks in
    their fields are read faster with ``multi_line=False``: Spark can then cut one file into
    many tasks.  The files of a folder must all have the columns of the first one in the
    same order; a file that differs raises.
    """
    options = {**CSV_READ, "multiLine": multi_line}
    as_text = StructType([
        StructField(f.name, StringType() if isinstance(f.dataType, ArrayType) else f.dataType)
        for f in schema.fields])
    header = csv_header(spark, path, multiLine=multi_line)
    df = spark.read.options(**options, enforceSchema=False) \
        .schema(_file_schema(header, as_text)).csv(path)
    columns = []
    for f in schema.fields:
        if f.name not in header:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, ArrayType):
            columns.append(parse_list(F.col(f.name)).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def read_first(spark: SparkSession, paths: Iterable[str], schema: StructType,
               empty: StructType | None = None, **options) -> DataFrame:
    """Table at the first existing path, or an empty table with the same columns."""
    path = first_existing(spark, paths)
    if path is None:
        return spark.createDataFrame([], empty or schema)
    return read_csv(spark, path, schema, **options)


def read_messages(spark: SparkSession, *paths: str, **options) -> DataFrame:
    return read_first(spark, paths, schemas.RAW_MESSAGES, **options)


def read_transactions(spark: SparkSession, *paths: str, **options) -> DataFrame:
    return read_first(spark, paths, schemas.RAW_TRANSACTIONS, **options)


def read_paragraphs(spark: SparkSession, *paths: str, **options) -> DataFrame:
    return read_first(spark, paths, schemas.RAW_PARAGRAPHS, schemas.EMPTY_PARAGRAPHS, **options)


def with_date(df: DataFrame, column: str = "date") -> DataFrame:
    """Parse the day-first text date; text of another form gives null."""
    return df.withColumn(column, F.try_to_date(F.col(column), K.DATE_FORMAT))


def write_tagged(df: DataFrame, path: str, file_format: str = "parquet",
                 partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV with list columns as JSON text.

    ``partition_by`` (the risk label, say) lets later searches skip whole folders.
    """
    if file_format == "csv":
        df = df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields
                             if isinstance(f.dataType, ArrayType)})
    options = CSV_WRITE if file_format == "csv" else {}
    df.write.mode("overwrite").format(file_format).options(**options) \
        .partitionBy(*partition_by).save(path)


def read_tagged(spark: SparkSession, path: str, schema: StructType,
                file_format: str = "parquet") -> DataFrame:
    """A tagged table, or an empty one when nothing has been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if file_format == "csv":
        return read_csv(spark, path, schema)
    return spark.read.format(file_format).load(path)


def master_export(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All tagged tables as ``table_name, record_id, payload`` with JSON payloads."""
    parts = [df.select(
        F.lit(name).alias("table_name"), F.col(record_id).cast("string").alias("record_id"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))
        for name, (df, record_id) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_master_export(export: DataFrame, path: str) -> None:
    """One folder of JSON lines per table, stamped with the time of the export."""
    export.withColumn("generated_at", F.current_timestamp()) \
        .write.mode("overwrite").partitionBy("table_name").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vector table; empty before it is first built."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.VECTORS)
    return spark.read.parquet(path)


def ensure_vectors(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored vector table, built and written first unless that was done to its end."""
    if not is_written(spark, path):
        write_vectors(build(), path)
    return read_vectors(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
        folder = context.getCheckpointDir()
    return folder


def write_shared(df: DataFrame, name: str) -> str:
    """Write an intermediate table to the shared folder and return its path.

    All tables of a run lie in one folder named after the application.
    """
    spark = df.sparkSession
    run = f"ledgerlens-{spark.sparkContext.applicationId}"
    path = f"{shared_folder(spark)}/{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several results read, and read it back.

    The written table survives the loss of executors, and later reads prune
    columns and rows instead of computing it again.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def regrouped(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with a shuffle of their own behind them.

    Spark splits a key that very many rows of a join share only if both sides come straight
    out of a shuffle.  A side that was just aggregated (or numbered) by the join key does
    not: it would be joined where it lies.  Dealt by another hash it is shuffled for the
    join once more, which costs little after an aggregate.
    """
    return df.repartition(F.xxhash64(F.lit("regrouped"), *[F.col(k) for k in keys]))
