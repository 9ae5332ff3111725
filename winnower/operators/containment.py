"""Which elements lie in which: cells in tables, text boxes in headers, any ancestor with any descendant.

Ids are in document order, and an element's descendants are the ids after its own up to last_desc_id. An ancestor's
span of length n is listed with the blocks of length 2^k that it touches, where 2^k is the largest power up to n: three
blocks at most. A descendant is in one block of each length that its part's ancestors have (at most one for each power),
so the two meet by equal keys. Spans in one block and of one length are few unless they lie in each other, in which
case they are answers; so the work grows with descendants, lengths and answers, whatever the nesting, and a large part
isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HERE = ("pkg_id", "part")


def power(length: Column) -> Column:
    """The exponent of the largest power of two up to a length."""
    return (F.length(F.bin(length.cast("bigint"))) - 1).cast("int")


def blocks(ancestors: DataFrame) -> DataFrame:
    """pkg_id, part, ancestor, last, k and block of each block that an ancestor's descendants touch."""
    spans = ancestors.where("last_desc_id > node_id").select(*HERE, F.col("node_id").alias("ancestor"), F.col("last_desc_id").alias("last"))
    spans = spans.withColumn("k", power(F.col("last") - F.col("ancestor")))
    first, final = F.expr("shiftright(CAST(ancestor + 1 AS BIGINT), k)"), F.expr("shiftright(CAST(last AS BIGINT), k)")
    return spans.select("*", F.explode(F.sequence(first, final)).alias("block"))


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """pkg_id, part, ancestor and descendant (ids) of each pair in which one of the descendants lies in one of the ancestors.

    ancestors: pkg_id, part, node_id, last_desc_id. descendants: pkg_id, part, node_id.
    """
    spans = blocks(ancestors)
    lengths = spans.groupBy(*HERE).agg(F.collect_set("k").alias("_lengths"))
    inside = descendants.select(*HERE, F.col("node_id").alias("descendant")).join(lengths, [*HERE]).select(*HERE, "descendant", F.explode("_lengths").alias("k"))
    inside = inside.withColumn("block", F.expr("shiftright(CAST(descendant AS BIGINT), k)"))
    met = inside.join(spans, [*HERE, "k", "block"])
    return met.where((F.col("descendant") > F.col("ancestor")) & (F.col("descendant") <= F.col("last"))).select(*HERE, "ancestor", "descendant")


def nearest(pairs: DataFrame) -> DataFrame:
    """The innermost ancestor of each descendant, and how many it lies in."""
    return pairs.groupBy(*HERE, "descendant").agg(F.max("ancestor").alias("ancestor"), F.count("*").alias("depth"))
