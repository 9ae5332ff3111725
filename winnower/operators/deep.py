"""Unreferenced parts and markup cruft: what is there (scan), what a clean removes, and what it saves.

Scan and clean differ on purpose where tags, patterns and files differ; each has its own function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.text import starts_with_any
from winnower.rules import BOOKMARK_PREFIXES, COMPAT_CLEAN_TAGS, COMPAT_KEPT_NAME, COMPAT_SCAN_TAGS, KEPT_SCRIPTS, RSID_SCAN, RSID_STRIP, RUN_CONTENT_TAGS, SAVED_BYTES

DOCUMENT, SETTINGS = "word/document.xml", "word/settings.xml"
THEME = r"^word/theme/[^/]+\.xml$"

# The parts whose empty elements are counted, and why a setting is listed.
EMPTY_SCANNED = (
    "word/document.xml", "word/styles.xml", "word/header1.xml", "word/header2.xml", "word/header3.xml",
    "word/footer1.xml", "word/footer2.xml", "word/footer3.xml", "word/footnotes.xml", "word/endnotes.xml",
)
COMPAT_REASONS = {
    "compatSetting": "Compatibility setting for legacy behavior",
    "useFELayout": "Far East layout compatibility",
    "useWord2002TableStyleRules": "Word 2002 table style compatibility",
    "growAutofit": "Legacy autofit behavior",
    "useWord97LineBreakRules": "Word 97 line break compatibility",
}
# End of fixed values.


def owning_part(rels: Column) -> Column:
    """The part that a relationship file belongs to; null at the package's root."""
    return F.when(F.contains(rels, F.lit("/_rels/")), F.regexp_replace(F.replace(rels, F.lit("/_rels/"), F.lit("/")), r"\.rels$", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def orphaned_media(media: DataFrame, rels: DataFrame) -> DataFrame:
    """Media files that end with no relationship target's base name, within their package.

    A file name ends with a base name only if the base name is one of its own ends, so each file lists its ends and
    the join is on equal keys; the ends of a file name are few, the empty one among them.
    """
    name = base_name(F.col("part"))
    ends = media.select("pkg_id", "part", F.explode(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(name, i, F.length(name)))).alias("end"))
    targets = rels.where(F.contains("target", F.lit("media/"))).select("pkg_id", base_name(F.col("target")).alias("end")).distinct()
    named = ends.join(targets, ["pkg_id", "end"], "left_semi").select("pkg_id", "part").distinct()
    return media.join(named, ["pkg_id", "part"], "left_anti")


def rsid_counts(parts: DataFrame, text: str = "xml") -> DataFrame:
    """How many revision attributes a scan counts and a strip removes, and the text's length after it."""
    c = F.col(text)
    return parts.select(
        "*",
        F.regexp_count(c, F.lit("(?i)" + RSID_SCAN)).cast("bigint").alias("scanned"),
        F.regexp_count(c, F.lit("(?i)" + RSID_STRIP)).cast("bigint").alias("stripped"),
        F.regexp_replace(c, "(?i)" + RSID_STRIP, "").alias("clean"),
    )


def internal_bookmark(name: Column) -> Column:
    return F.coalesce(starts_with_any(name, BOOKMARK_PREFIXES), F.lit(False))


def bookmark_reason(name: Column) -> Column:
    return F.when(name == "_GoBack", "Cursor position bookmark").when(name.startswith("_Hlk"), "Hyperlink anchor bookmark").otherwise("Internal Word bookmark")


def bookmark_pairs(nodes: DataFrame) -> DataFrame:
    """Internal bookmark starts of main parts, and the ends that go with them by id within their package."""
    nodes = nodes.where(F.col("part") == DOCUMENT)
    starts = nodes.where((F.col("tag") == "bookmarkStart") & internal_bookmark(F.col("name")))
    ends = nodes.where(F.col("tag") == "bookmarkEnd").join(starts.select("pkg_id", "bm_id").distinct(), ["pkg_id", "bm_id"], "left_semi")
    columns = ("pkg_id", "node_id", "tag", "bm_id")
    return starts.select(*columns, bookmark_reason(F.col("name")).alias("reason")).union(ends.select(*columns, F.lit(None).cast("string")))


def compat_scanned(tag: Column, name: Column) -> Column:
    return tag.isin(list(COMPAT_SCAN_TAGS)) & ~((tag == "compatSetting") & F.contains(F.coalesce(name, F.lit("")), F.lit(COMPAT_KEPT_NAME)))


def compat_listed(nodes: DataFrame) -> DataFrame:
    """Compatibility settings that a scan lists, with the reason: children of a compat element of the settings part."""
    tag, name = F.col("tag"), F.coalesce("name", F.lit(""))
    reason = F.create_map(*(F.lit(x) for pair in COMPAT_REASONS.items() for x in pair))
    found = nodes.where((F.col("part") == SETTINGS) & (F.col("parent_tag") == "compat") & compat_scanned(tag, name))
    return found.select("pkg_id", F.when(tag == "compatSetting", F.concat(F.lit("compatSetting: "), name)).otherwise(tag).alias("setting"), reason[tag].alias("reason"))


def font_mappings(nodes: DataFrame) -> DataFrame:
    """Fonts that theme parts map to scripts other than the kept ones."""
    found = nodes.where(F.col("part").rlike(THEME) & (F.col("tag") == "font") & foreign_script(F.col("script")))
    return found.select("pkg_id", F.col("part").alias("file"), "script", F.coalesce("typeface", F.lit("")).alias("typeface"))


def compat_cleaned(tag: Column) -> Column:
    return tag.isin(list(COMPAT_CLEAN_TAGS))


def proof_scanned(part: Column, tag: Column) -> Column:
    return ((part == SETTINGS) & tag.isin("proofState", "proofErr", "noProof")) | ((part == DOCUMENT) & (tag == "proofErr"))


def proof_cleaned(part: Column, tag: Column) -> Column:
    return ((part == SETTINGS) & tag.isin("proofState", "proofErr")) | ((part == DOCUMENT) & (tag == "proofErr"))


def has_content(child_tags: Column) -> Column:
    """Whether an array of child tags holds one that a run counts as content."""
    return F.exists(child_tags, lambda t: t.isin(list(RUN_CONTENT_TAGS)))


def foreign_script(script: Column) -> Column:
    return F.coalesce((script != "") & ~F.lower(script).isin(list(KEPT_SCRIPTS)), F.lit(False))


def vendor_link(target: Column, kind: Column, mode: Column, domains: Sequence[str]) -> Column:
    """An external hyperlink whose target contains a domain."""
    named = F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: F.contains(F.lower(target), d)) if domains else F.lit(False)
    return (F.coalesce(mode, F.lit("Internal")) == "External") & F.contains(kind, F.lit("relationships/hyperlink")) & named


def cruft_counts(nodes: DataFrame) -> DataFrame:
    """Per package, the counts that the savings estimate weighs."""
    tag, name, part = F.col("tag"), F.col("name"), F.col("part")
    empty = (tag == "r") & ~F.coalesce(F.col("child_tag").isin(list(RUN_CONTENT_TAGS)), F.lit(False)) | (tag == "rPr") & F.col("child_tag").isNull()
    return nodes.groupBy("pkg_id").agg(
        F.count_if(empty & part.isin(list(EMPTY_SCANNED))).alias("empty"),
        F.count_if(part.rlike(THEME) & (tag == "font") & foreign_script(F.col("script"))).alias("font"),
        F.count_if((part == SETTINGS) & (F.col("parent_tag") == "compat") & compat_scanned(tag, name)).alias("compat"),
        F.count_if((part == DOCUMENT) & (tag == "bookmarkStart") & internal_bookmark(name)).alias("bookmark"),
        F.count_if(proof_scanned(part, tag)).alias("proof"),
    )


def estimated_savings(media: DataFrame, orphans: DataFrame, rsids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bytes a clean is expected to save, per package: orphaned media at size, the rest by weight."""
    files = media.groupBy("pkg_id").agg(F.sum("size_bytes").alias("media"))
    styles = orphans.groupBy("pkg_id").agg(F.count("*").alias("style"))
    marks = rsids.groupBy("pkg_id").agg(F.sum("scanned").alias("rsid"))
    joined = files.join(styles, "pkg_id", "full").join(marks, "pkg_id", "full").join(cruft_counts(nodes), "pkg_id", "full")
    total = F.coalesce("media", F.lit(0))
    for what in ("style", "rsid", "empty", "font", "compat", "bookmark", "proof"):
        total = total + F.coalesce(F.col(what), F.lit(0)) * SAVED_BYTES[what]
    return joined.select("pkg_id", total.cast("bigint").alias("estimated_bytes"))
