"""Cleaning that goes on where it was stopped, and does only what is new or has changed.

Results are rows of one Parquet folder: a package's cleaned content beside the hash of what came in and the number of the
run. A row is whole in itself, so whatever a killed run has committed is done, and what it hasn't isn't there; there is
no second list that could disagree. A run takes packages whose id and hash aren't among the results, in batches, each
committed on its own, so that little is lost with one.

Defined results: a package that came in before with other content is cleaned again, and its later row counts; one that no
longer comes in keeps its row; a package with an error counts as done, with what came in, until it changes; rows that repeat
an id in one run are undefined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Clean = Callable[[DataFrame], DataFrame]
RESULT = "pkg_id string, sha256 string, content binary, error string, run bigint"
BATCHES = 4


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all runs; none if nothing was committed yet."""
    try:
        return spark.read.schema(RESULT).parquet(folder)
    except AnalysisException:  # the folder isn't there
        return spark.createDataFrame([], RESULT)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """pkg_id, content, error, sha256 and run of each package's last row."""
    rest = ("content", "error", "sha256", "run")
    rows = results(spark, folder).groupBy("pkg_id").agg(F.max_by(F.struct(*rest), "run").alias("r"))
    return rows.select("pkg_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def clean_new(packages: DataFrame, folder: str, clean: Clean, batches: int = BATCHES) -> int:
    """Cleans packages (pkg_id, content) that aren't done yet; gives the run's number.

    clean: from packages to pkg_id, content and error. The ids and hashes of what is done are read without contents.
    """
    spark = packages.sparkSession
    run = (results(spark, folder).agg(F.max("run")).first()[0] or 0) + 1
    marked = packages.select("pkg_id", "content", F.sha2("content", 256).alias("sha256"))
    for batch in range(batches):
        done = results(spark, folder).groupBy("pkg_id").agg(F.max_by("sha256", "run").alias("sha256"))
        todo = marked.where(F.pmod(F.xxhash64("pkg_id"), F.lit(batches)) == batch).join(done, ["pkg_id", "sha256"], "left_anti")
        hashes = todo.select(F.col("pkg_id").alias("of"), "sha256")
        cleaned = clean(todo.select("pkg_id", "content")).join(hashes, F.col("pkg_id") == F.col("of"))
        cleaned.select("pkg_id", "sha256", "content", "error", F.lit(run).cast("bigint").alias("run")).write.mode("append").parquet(folder)
    return run
