"""Cleaning packages as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnower.plans.api import shallow_clean
from winnower.rules import DEFAULT, Rules
from winnower.sources.packages import unpack

Clean = Callable[[DataFrame], DataFrame]
FILES_MORE = 32  # so many times the files that Spark would give a task


def clean_batch(packages: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """pkg_id, content and error of each package after a shallow clean; with an error, the content is what came in."""
    return shallow_clean(unpack(packages), rules).packages(packages)


def gathered(files: DataFrame) -> DataFrame:
    """Files in fewer tasks. A small file weighs as its opening does in Spark's split, so a task would get few of them, and each has its price."""
    many = files.rdd.getNumPartitions()
    least = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, many // FILES_MORE)) if many > least else files


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, clean: Clean = clean_batch) -> StreamingQuery:
    """Reads new files of a folder once each and appends the cleaned packages as Parquet; a batch that is tried again overwrites its own rows."""

    def handle(batch: DataFrame, number: int) -> None:
        clean(gathered(batch.select(F.col("path").alias("pkg_id"), "content"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
