"""The markup clean-ups on web pages: by patterns, as pages are seldom well formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_ATTRIBUTE = r'\s+class="[^"]*"'
COMMENT = r"(?s)<!--.*?-->"
EMPTY_TAG = r"<(p|b|i|em|span|div|li|td)>\s*</\1>"
ANCHOR = r'<a\s[^>]*href="([^"]*)"[^>]*>'


def strip(pages: DataFrame, pattern: str) -> DataFrame:
    """How often a pattern occurs, and how many characters go with it."""
    clean = F.regexp_replace("html", pattern, "")
    return pages.select("page_id", F.regexp_count("html", F.lit(pattern)).cast("bigint").alias("removed"), (F.length("html") - F.length(clean)).cast("bigint").alias("saved_chars"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def links(pages: DataFrame) -> DataFrame:
    """A row for each link; a relative target belongs to the page's own host."""
    targets = pages.select("page_id", host(F.col("url")).alias("own"), F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("target"))
    return targets.select("page_id", "target", F.when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host(F.col("target"))).otherwise(F.col("own")).alias("host"))


def links_by_domain(pages: DataFrame) -> DataFrame:
    return links(pages).groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


def unwrap_links(pages: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Drops the anchors to targets that contain one of the domains, and keeps what they enclose."""
    named = "|".join("\\Q" + d + "\\E" for d in domains)
    pattern = rf'(?is)<a\s[^>]*href="[^"]*(?:{named})[^"]*"[^>]*>(.*?)</a>'
    clean = F.regexp_replace("html", pattern, "$1")
    return pages.select("page_id", F.regexp_count("html", F.lit(pattern)).cast("bigint").alias("unwrapped"), F.length(clean).cast("bigint").alias("clean_chars"))
