"""Tables and message files: parquet in and out by folder, and JSON lines as a queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A table; with a schema its columns are read by name, and lacking ones are null."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}")


def append(rows: DataFrame, root: str, name: str, by: Sequence[str] = ()) -> None:
    """Bulk insert; ``by`` are folders, such as the tenant."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root.rstrip('/')}/{name}")


def overwrite(rows: DataFrame, root: str, name: str, by: Sequence[str] = ()) -> None:
    """Replace a table, or with ``by`` only the folders that ``rows`` has.

    ``rows`` must not read the table itself: write to another name first.
    """
    writer = rows.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{root.rstrip('/')}/{name}")


def queue(spark: SparkSession, path: str, batch_files: int | None = None) -> DataFrame:
    """A stream of messages (routing_key, value) from a folder of JSON lines."""
    reader = spark.readStream.schema("routing_key string, value string")
    return (reader if batch_files is None else reader.option("maxFilesPerTrigger", batch_files)).json(path)


def send(messages: DataFrame, path: str) -> None:
    """Append messages to a folder that ``queue`` reads."""
    messages.select("routing_key", "value").write.mode("append").json(path)
