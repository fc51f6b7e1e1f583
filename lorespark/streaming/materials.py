"""Points kept up to date by a stream of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from lorespark.operators.materials import refreshed_after_edits

TABLES = ("materials", "points")


def version(store: str, table: str, number: int) -> str:
    return f"{store}/{table}/v={number}"


def read_version(spark: SparkSession, store: str, number: int) -> tuple[DataFrame, DataFrame]:
    """Materials and points as batch ``number`` has left them."""
    materials, points = (spark.read.parquet(version(store, table, number)) for table in TABLES)
    return materials, points


def start_store(materials: DataFrame, points: DataFrame, store: str) -> None:
    """Write the tables before the first batch, as version -1."""
    for table, rows in zip(TABLES, (materials, points), strict=True):
        rows.write.mode("overwrite").parquet(version(store, table, -1))


def refresh_by_edits(edits: DataFrame, store: str, now: Column | None = None) -> DataStreamWriter:
    """A writer that, for each micro-batch of edits, writes the next version of materials and points.

    A batch reads the version before it and overwrites its own, so a batch that is run again after a failure gives the
    same tables. store: a folder that all executors share; old versions may be removed once a later one is whole.
    """

    def apply(batch: DataFrame, number: int) -> None:
        materials, points = read_version(batch.sparkSession, store, number - 1)
        for table, rows in zip(TABLES, refreshed_after_edits(materials, points, batch, now), strict=True):
            rows.write.mode("overwrite").parquet(version(store, table, number))

    return edits.writeStream.foreachBatch(apply)
