"""Counts, numbered previews and nested reports over detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnower.functions.text import preview


def counts_by_type(found: DataFrame) -> DataFrame:
    """Detections, documents and summed confidence of each content type, ordered by type."""
    return found.groupBy("content_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.round(F.sum("confidence"), 4).alias("sum_conf")).orderBy("content_type")


def removed_and_preserved(found: DataFrame) -> DataFrame:
    kept = F.col("content_type") == "preserve"
    return found.groupBy("doc_id").agg(F.count_if(~kept).alias("removed"), F.count_if(kept).alias("preserved"))


def numbered(found: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("pos", "ord")) -> DataFrame:
    """Detections numbered within their document, with previews."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("nth", nth.cast("bigint")).withColumn("preview", preview(F.col("txt")))


def nested(totals: DataFrame, key: str = "pkg_id") -> DataFrame:
    """Each row's report as JSON."""
    return totals.select(key, F.to_json(F.struct(*[c for c in totals.columns if c != key])).alias("report"))


def shown(kind: Column, text: Column, confidence: Column) -> Column:
    """A detection in one line: its type, the first 50 characters in quotes, and its confidence."""
    short = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    return F.format_string("Detection(%s, '%s', conf=%.2f)", kind, short, confidence)
