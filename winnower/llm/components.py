"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm.common import discard, materialize, new_folder


def star(links: DataFrame, large: bool) -> DataFrame:
    """Ties each node's larger (or smaller) neighbours to the least of its neighbours and itself."""
    if large:
        around = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("node", "next")
    else:
        around = links.select(F.greatest("a", "b"), F.least("a", "b")).toDF("node", "next")
    least = around.groupBy("node").agg(F.min("next").alias("least")).select(F.col("node").alias("of"), F.least("node", "least").alias("least"))
    tied = around.join(least, F.col("node") == F.col("of"))
    if large:
        tied = tied.where(F.col("next") > F.col("node")).select(F.col("next").alias("a"), F.col("least").alias("b"))
    else:
        tied = tied.select(F.col("next").alias("a"), F.col("least").alias("b")).union(least.select(F.col("of").alias("a"), F.col("least").alias("b")))
    return tied.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links of longs a and b; returns node and component (the least node) of every node that has a link.

    Each step is written to the shared folder and the one before it deleted; the links settle, whatever their number. A null end and a link of a node with itself are left out.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    spark, folder = links.sparkSession, new_folder(links.sparkSession)
    now, seen, step = materialize(ends, "0", folder), None, 0
    while True:
        now = materialize(star(star(now, large=True), large=False), str(step + 1), folder)
        discard(spark, folder, str(step))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, step = mark, step + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
