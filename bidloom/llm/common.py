"""What the training-data operators share: table reading and batch sizes; the shared folder, lineage cuts, hot-key joins and components are the core's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidloom.shared import clear, components, cut, drop, join_counted, scratch, shared_dir, unused  # noqa: F401

#: Rows per Arrow batch sent to Python workers, so that a batch of long texts stays small.
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at ``ARROW_ROWS`` rows where the user has not set their size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_ROWS))
