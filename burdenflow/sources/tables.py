"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(
    spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", null_value: str = "NA"
) -> DataFrame:
    """Read a table with a declared schema. CSV cells that are empty or ``NA`` are NULL."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a declared schema")
        return spark.read.schema(schema).csv(path, header=True, nullValue=null_value)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_sheet(
    spark: SparkSession, path: str, headers: Mapping[str, str], schema: str, null_value: str = "NA"
) -> DataFrame:
    """Read a landed sheet by its column headers: keep those listed, rename and type them.

    Columns are found by header, so their order and further columns do not matter. A cell
    that is not of the declared type is NULL.
    """
    sheet = spark.read.csv(path, header=True, nullValue=null_value)
    kinds = dict(spark.createDataFrame([], schema).dtypes)
    return sheet.select(*[F.col(f"`{old}`").try_cast(kinds[new]).alias(new) for old, new in headers.items()])


def read_parts(
    spark: SparkSession, glob: str, schema: str, provenance: str = "file_id", null_value: str = "NA", by_folder: bool = False
) -> DataFrame:
    """Read every CSV part that matches in one scan; ``provenance`` is the part's name.

    With ``by_folder`` a part is a folder ``<provenance>=<name>`` of files.
    """
    parts = spark.read.schema(schema).csv(glob, header=True, nullValue=null_value)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"{provenance}=([^/]*)/[^/]*$", 1)
    return parts.select("*", F.url_decode(folder if by_folder else name).alias(provenance))


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), compression: str | None = None
) -> str:
    """Write a new table. A compressed CSV table is read back like a plain one, a file in one task."""
    writer = df.write.format(fmt).mode("errorifexists").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.save(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    """Replace the partitions of a stored table that ``df`` has rows of; the table's other partitions stay.

    The rows are staged first, so a lost task or a failed job leaves the stored partitions as they were.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return path


def store_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Store rows in ``buckets`` files by the columns ``by``, sorted by them, and read them back as a table.

    A join or grouping on ``by`` then reads each bucket in one task, without another shuffle of the stored rows. Rows
    of one key share a bucket. Missing keys are a key of their own.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or else the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new table and read back: worked out once, and of known size."""
    path = write_table(df, new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
