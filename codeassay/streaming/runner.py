"""Run a stream over everything that has arrived, then read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.session import scratch_path


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input into parquet files and return them as a table.

    The sink and the checkpoint live in the shared folder, so a run survives
    lost executors and can be continued from where it stopped.
    """
    spark: SparkSession = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, name + "-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, name: str, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input in update mode into a table with the last state of each key.

    Each trigger writes what changed to a folder of its own, which a repeated
    trigger overwrites; the newest row of a key holds.  So open windows are in
    the result too.
    """
    spark: SparkSession = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, name + "-checkpoint")

    def store(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger={trigger}")

    query = stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, trigger bigint").parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("_x"))
    return newest.select(*[F.col(c) if c in keys else F.col("_x")[c].alias(c) for c in stream.columns])
