"""What of a package its root reaches: parts, relationships, fonts, numberings and styles as one graph.

Things are nodes, named by kind and name within their package; an edge says that the one keeps the other. From the root
of a package (its root relationships) everything that some chain of edges leads to is kept; what is defined and not
reached is orphaned. A relationship is kept if it is the root's, if its type is one that needs no mention (a part's own
styles, settings, fonts, ...), or if the part that owns it mentions its id; a kept relationship keeps the part it
targets, a kept part keeps the fonts, numberings and styles that it names, and a kept style those that it is based on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.operators.deep import owning_part
from winnower.operators.styles import closure_of_edges

#: Relationship types that a part keeps without a mention of their id: the last piece of the type's name. Fixed values.
IMPLICIT = (
    "styles", "stylesWithEffects", "settings", "webSettings", "fontTable", "numbering", "theme", "footnotes", "endnotes", "comments", "customXml", "glossaryDocument",
    "commentsExtended", "commentsIds", "commentsExtensible", "people", "customXmlProps", "attachedTemplate",
)
SEPARATOR = "\t"  # between the kind and the name of a node


def node(kind: str, *name: Column | str) -> Column:
    """A thing of a package as text; no name holds the separator, as attribute values lose tabs when they are read."""
    return F.concat_ws(SEPARATOR, F.lit(kind), *name)


def target_part(source_file: Column, target: Column) -> Column:
    """The part that a relationship targets: absolute, or relative to the folder of its owner, with its dots resolved."""
    folder = F.regexp_replace(F.regexp_replace(source_file, r"(^|/)_rels/[^/]*$", ""), r"/+$", "")
    path = F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), target))
    steps = F.filter(F.split(path, "/"), lambda s: (s != ".") & (s != ""))
    last = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    resolved = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", last(kept)).otherwise(F.array_append(kept, s)))
    return F.array_join(resolved, "/")


def relationship_edges(rels: DataFrame) -> DataFrame:
    """pkg_id, src, dst: owners keep relationships that need no mention, and relationships keep their targets."""
    owner = owning_part(F.col("source_file"))
    own = F.when(F.col("source_file") == "_rels/.rels", F.lit("root")).when(F.substring_index("type", "/", -1).isin(list(IMPLICIT)), node("part", owner))
    this = node("rel", "source_file", "rid")
    implicit = rels.select("pkg_id", own.alias("src"), this.alias("dst")).where(F.col("src").isNotNull())
    targets = rels.where("target_mode <> 'External'").select("pkg_id", this.alias("src"), node("part", target_part(F.col("source_file"), F.col("target"))).alias("dst"))
    return implicit.union(targets)


def reference_edges(references: DataFrame) -> DataFrame:
    """pkg_id, src, dst: parts keep what they name (references: pkg_id, part, kind, ref)."""
    rels = F.concat(F.regexp_replace("part", r"[^/]*$", ""), F.lit("_rels/"), F.substring_index("part", "/", -1), F.lit(".rels"))
    named = F.when(F.col("kind") == "rid", node("rel", rels, F.col("ref"))).otherwise(node_of_kind(F.col("kind"), F.col("ref")))
    return references.select("pkg_id", node("part", "part").alias("src"), named.alias("dst"))


def node_of_kind(kind: Column, name: Column) -> Column:
    return F.concat_ws(SEPARATOR, kind, name)


def style_edges_as_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("pkg_id", node("style", "src").alias("src"), node("style", "dst").alias("dst"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """pkg_id and node of all that a package's root reaches; one task follows a package's edges."""
    seeds = roots.select("pkg_id", F.lit("root").alias("dst")).distinct()
    return closure_of_edges(edges, seeds).toDF("pkg_id", "node")


def orphans(defined: DataFrame, kept: DataFrame) -> DataFrame:
    """pkg_id, kind and name of what is defined (pkg_id, kind, name) and not reached."""
    marked = defined.withColumn("node", node_of_kind(F.col("kind"), F.col("name")))
    return marked.join(kept, ["pkg_id", "node"], "left_anti").select("pkg_id", "kind", "name")
