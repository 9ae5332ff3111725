"""Which style definitions can be reached from the content, by transitive closure."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from winnower.rules import ALWAYS_USED_STYLES, PROTECTED_STYLES

BATCH_ROWS = 20_000
EDGES = (("basedOn", "based_on"), ("link", "linked"), ("next", "next_style"))


def style_edges(styles: DataFrame) -> DataFrame:
    """pkg_id, src, dst and kind of each reference of a style to another."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("dst")) for kind, column in EDGES))
    return styles.select("pkg_id", F.col("style_id").alias("src"), F.inline(kinds)).where(F.col("dst").isNotNull())


def reach(edges: Iterable[tuple[str | None, str]]) -> list[str]:
    """What a package's seeds (edges without src) reach over its edges, themselves included."""
    after, front = defaultdict(list), []
    for src, dst in edges:
        if src is None:
            front.append(dst)
        else:
            after[src].append(dst)
    seen = dict.fromkeys(front)
    while front:
        here = front.pop()
        for dst in after.pop(here, ()):
            if dst not in seen:
                seen[dst] = None
                front.append(dst)
    return list(seen)


def closure_of_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """pkg_id and style_id (any name) of what seeds (pkg_id, dst) reach over edges (pkg_id, src, dst), themselves included.

    Edges and seeds of a package meet in one task, which follows each edge once: one shuffle, no job of its own. A
    package's edges come from parts that one task has parsed before, so they are bounded as those are.
    """
    key = edges.schema["pkg_id"].dataType.simpleString()
    key_type = to_arrow_schema(edges.select("pkg_id").schema).field(0).type
    rows = edges.select("pkg_id", "src", "dst").union(seeds.select("pkg_id", F.lit(None).cast("string").alias("src"), "dst"))

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (row for frame in frames for row in zip(*(frame.column(c).to_pylist() for c in ("pkg_id", "src", "dst")), strict=True))
        packages, found = [], []
        for pkg, group in itertools.groupby(cells, key=lambda row: row[0]):
            names = reach((src, dst) for _, src, dst in group)
            packages += [pkg] * len(names)
            found += names
            if len(found) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(packages, key_type), pa.array(found, pa.string())], names=["pkg_id", "style_id"])
                packages, found = [], []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(packages, key_type), pa.array(found, pa.string())], names=["pkg_id", "style_id"])

    return rows.repartition("pkg_id").sortWithinPartitions("pkg_id").mapInArrow(each, f"pkg_id {key}, style_id string")


def closure(styles: DataFrame, used: DataFrame) -> DataFrame:
    """Styles reached from the used ones, undefined targets included, however long the chains and whatever the cycles."""
    return closure_of_edges(style_edges(styles), used.select("pkg_id", F.col("style_id").alias("dst")))


def closure_with_defaults(styles: DataFrame, used: DataFrame) -> DataFrame:
    """The closure with the always used styles of each package added afterwards, unexpanded."""
    always = styles.select("pkg_id").distinct().select("pkg_id", F.explode(F.array(*map(F.lit, ALWAYS_USED_STYLES))).alias("style_id"))
    return closure(styles, used).union(always).distinct()


def style_status(styles: DataFrame, reached: DataFrame) -> DataFrame:
    """used, protected (unused but kept) or unused of each definition."""
    mark = reached.select("pkg_id", "style_id").distinct().withColumn("_used", F.lit(True))
    kept = F.col("style_id").isin(list(PROTECTED_STYLES)) | F.coalesce("is_default", F.lit(False))
    return styles.join(mark, ["pkg_id", "style_id"], "left").withColumn("status", F.when(F.col("_used"), "used").when(kept, "protected").otherwise("unused")).drop("_used")


def orphaned_styles(styles: DataFrame, used: DataFrame) -> DataFrame:
    """Definitions outside the closure with defaults: no protection by name or default flag."""
    return styles.join(closure_with_defaults(styles, used), ["pkg_id", "style_id"], "left_anti")


def style_totals(styles: DataFrame, used: DataFrame) -> DataFrame:
    """Counts of a package; used counts undefined styles too."""
    reached = closure(styles, used)
    status = style_status(styles, reached)
    counts = status.groupBy("pkg_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("protected", "unused")), F.count("*").alias("n_defined"))
    return counts.join(reached.groupBy("pkg_id").agg(F.count("*").alias("n_used")), "pkg_id", "left").select("pkg_id", "n_defined", F.coalesce("n_used", F.lit(0)).alias("n_used"), "n_unused", "n_protected")
