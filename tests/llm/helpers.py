"""Small tables with the awkward cases that every operator must take."""

import re

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def with_clash(df):
    """Extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    return df.withColumn("score", F.lit("x")).withColumn("tokens", F.lit(1)).withColumn("class", F.lit(2)).withColumn("_n", F.lit(3)).withColumn("rank", F.lit(4)).withColumn("spans", F.lit(5)).withColumn("block", F.lit(6))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return with_clash(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS))


LONG = "a long text of many words and then some more " * 3000
ODD = [(1, None, "s1"), (2, "", "s2"), (3, "  \n\t", None), (4, "one", "s1"), (4, "one", "s1"), (None, "One two", "s3"), (5, "é ü ñ — 日本", "s2"), (6, LONG, "s4"), (7, "ONE", "s5")]
