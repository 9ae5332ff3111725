"""Cleaning and analysing whole packages: the stages as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.scratch import materialize
from winnower.functions.text import any_of, nonblank
from winnower.operators import deep, detect, reachability, styles
from winnower.rules import COMPAT_CLEAN_TAGS, DEFAULT, KEPT_SCRIPTS, RSID_STRIP, RUN_CONTENT_TAGS, Rules
from winnower.sources import packages as P

OPERATIONS = ("media", "styles", "rsids", "rsid_registry", "empty", "fonts", "compat", "links", "bookmarks", "proof")
APP = "docProps/app.xml"
STYLES = "word/styles.xml"
SPAN = ("pkg_id", "part", "b0", "b1")

#: What each step asks of the shredder: names of elements, and columns.
TEXT_NAMES = ("w:p", "w:r")
TEXT_COLUMNS = (*SPAN, "node_id", "name", "up", "txt", "style", "italic", "bold", "hidden", "color", "highlight", "font", "half_points", "paras", "error")
STYLE_NAMES, STYLE_REFERENCES = ("w:style",), ("pStyle", "rStyle", "tblStyle", "numStyleLink")
STYLE_COLUMNS = (*SPAN, "node_id", "depth", "name", "tag", "attrs", "style_name", "based_on", "linked", "next_style", "error")
REFERENCES = ("pStyle", "rStyle", "tblStyle", "rFonts", "numId")
REFERENCE_COLUMNS = ("pkg_id", "part", "tag", "attrs", "error")
RELATIONSHIPS = ("*Relationship",)
RELATIONSHIP_COLUMNS = (*SPAN, "name", "tag", "depth", "attrs", "error")
INVENTORY = ("w:font", "w:num")
DEEP_NAMES = (*STYLE_NAMES, *STYLE_REFERENCES, *RELATIONSHIPS, "w:rsids", "w:r", "font", "w:compat", *COMPAT_CLEAN_TAGS, "w:bookmarkStart", "w:bookmarkEnd", "proofErr", "proofState", "w:hyperlink", "HLinks")
DEEP_COLUMNS = (*STYLE_COLUMNS, "up", "open_end", "close_start", "children")


@dataclass
class Cleaned:
    parts: DataFrame  # what remains
    detections: DataFrame  # what was found
    cuts: DataFrame  # what was removed
    faults: DataFrame | None = None  # packages left as they were, and why
    source: DataFrame | None = None  # the parts that the cuts are of
    marks: str | None = None  # a pattern of what goes from all XML parts

    def packages(self, packages: DataFrame) -> DataFrame:
        """pkg_id, content and error of the cleaned packages; splices and packs in one pass over the bytes."""
        return P.rewrite(self.source, self.cuts, packages, self.marks)


def shallow_detections(nodes: DataFrame, rules: Rules = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (own) and runs (found) with their detections, each worked out once."""
    paragraphs = detect.with_detections(P.paragraphs(nodes), detect.paragraph_element(), rules, "own")
    runs = detect.with_detections(P.runs(nodes), detect.run_element(), rules)
    return materialize(paragraphs, "paragraphs"), materialize(runs.select("pkg_id", "part", "run", "txt", "parent_is_p", "b0", "b1", "paras", nonblank(F.col("txt")).alias("solid"), "found"), "runs")


def shallow_clean(parts: DataFrame, rules: Rules = DEFAULT) -> Cleaned:
    """Removes non-content paragraphs and loose runs; runs detected in paragraphs that stay are only reported.

    A package with a part that isn't well formed is left as it is, and listed in faults.
    """
    parts = materialize(parts, "parts")
    nodes = materialize(P.shred(parts.where(P.shallow_part(F.col("part"))), TEXT_NAMES, TEXT_COLUMNS), "nodes")
    faults = nodes.where(F.col("error").isNotNull()).select("pkg_id", "part", "error")
    sound = nodes.join(faults.select("pkg_id").distinct(), "pkg_id", "left_anti")
    paragraphs, runs = shallow_detections(sound, rules)
    keys = ["pkg_id", "part", "para_id"]
    spotted = runs.where("solid").select("*", F.explode("paras").alias("para_id")).drop("paras")
    loose = runs.where(~F.col("parent_is_p"))  # the second look: blank ones too, whatever the paragraph
    removed = detect.decide_found(paragraphs.select(*keys, "b0", "b1", "own"), spotted.select(*keys, "found"), keys, ("b0", "b1")).where("removed")
    cuts = materialize(removed.select(*SPAN).union(loose.where(detect.removable(F.col("found"))).select(*SPAN)).distinct(), "cuts")
    by_run = spotted.join(paragraphs.where(~detect.settled(F.col("own"))).select(*keys), keys)
    found = [
        detect.exploded(paragraphs.select("pkg_id", "part", F.lit("paragraph").alias("level"), F.col("para_id").alias("element"), "txt", F.col("own").alias("found"))),
        detect.exploded(by_run.select("pkg_id", "part", F.lit("run").alias("level"), F.col("run").alias("element"), "txt", "found")),
        detect.exploded(loose.select("pkg_id", "part", F.lit("loose run").alias("level"), F.col("run").alias("element"), "txt", "found")),
    ]
    return Cleaned(P.splice(parts, cuts), found[0].union(found[1]).union(found[2]), cuts, faults, parts)


def style_definitions(nodes: DataFrame, deep: bool = False) -> DataFrame:
    """Direct children of the style part's root that have an id; a repeated id counts with its last definition.

    deep: at any depth, and without an id too (as the empty one).
    """
    style_id = F.coalesce(F.col("attrs")["w:styleId"], F.lit(""))
    style = nodes.where((F.col("part") == STYLES) & (F.col("name") == "w:style"))
    if not deep:
        style = style.where((F.col("depth") == 1) & (style_id != ""))
    rows = style.select(
        "pkg_id", "node_id", style_id.alias("style_id"), F.coalesce("style_name", style_id).alias("name"), "based_on", "linked", "next_style",
        F.coalesce(F.col("attrs")["w:type"], F.lit("paragraph")).alias("style_type"), F.coalesce(F.col("attrs")["w:default"] == "1", F.lit(False)).alias("is_default"), "b0", "b1",
    )
    columns = [c for c in rows.columns if c not in ("pkg_id", "style_id")]
    last = rows.groupBy("pkg_id", "style_id").agg(F.max_by(F.struct(*columns), "node_id").alias("s"))
    return last.select("pkg_id", "style_id", *(F.col(f"s.{c}").alias(c) for c in columns))


def style_references(nodes: DataFrame, everywhere: bool) -> DataFrame:
    """Styles named by content; everywhere: comments and numbering links too."""
    parts = P.style_part(F.col("part")) if everywhere else P.reference_part(F.col("part"))
    named = F.col("name").isin("w:pStyle", "w:rStyle", "w:tblStyle", "w:numStyleLink") if everywhere else F.col("tag").isin("pStyle", "rStyle", "tblStyle")
    named = nodes.where(parts & named).select("pkg_id", F.col("attrs")["w:val"].alias("style_id"))
    return named.where(F.coalesce("style_id", F.lit("")) != "").distinct()


def typed_references(nodes: DataFrame) -> DataFrame:
    """Distinct pkg_id, part, kind (rid, style, font, number) and ref of what elements refer to."""
    tag, a = F.col("tag"), F.col("attrs")
    ref = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("ref"))
    none = F.array().cast("array<struct<kind:string,ref:string>>")
    mentions = F.filter(F.map_entries(a), lambda e: (F.contains(F.lower(e["key"]), F.lit("id")) | F.contains(F.lower(e["key"]), F.lit("embed"))) & e["value"].startswith("rId"))
    named = F.when(tag.isin("pStyle", "rStyle", "tblStyle"), F.array(ref("style", a["w:val"])))
    named = named.when(tag == "rFonts", F.array(*(ref("font", a[f"w:{f}"]) for f in ("ascii", "hAnsi", "cs", "eastAsia"))))
    named = named.when((tag == "numId") & (a["w:val"] != "0"), F.array(ref("number", a["w:val"]))).otherwise(none)
    found = nodes.where(F.size("attrs") > 0).select("pkg_id", "part", F.inline(F.concat(F.transform(mentions, lambda e: ref("rid", e["value"])), named)))
    return found.where(F.coalesce("ref", F.lit("")) != "").distinct()


def inventory(nodes: DataFrame) -> DataFrame:
    """Distinct pkg_id, kind and name of the fonts and numberings that a package defines."""
    part, name, a = F.col("part"), F.col("name"), F.col("attrs")
    font, number = (part == "word/fontTable.xml") & (name == "w:font"), (part == "word/numbering.xml") & (name == "w:num")
    found = nodes.where(font | number).select("pkg_id", F.when(font, "font").otherwise("number").alias("kind"), F.when(font, a["w:name"]).otherwise(a["w:numId"]).alias("name"))
    return found.where(F.coalesce("name", F.lit("")) != "").distinct()


def unreached(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """pkg_id, kind (part, rel, font, number, style) and name of what a package defines and its root doesn't reach.

    Fonts and numberings are those of the font table and the numbering part; a relationship's name is its file and id. A
    package without root relationships reaches nothing.
    """
    sound = nodes.where(F.col("error").isNull())
    rels, defined = defined_relationships(sound), style_definitions(sound, deep=True)
    edges = reachability.relationship_edges(rels).union(reachability.reference_edges(typed_references(sound)))
    edges = edges.union(reachability.style_edges_as_nodes(styles.style_edges(defined)))
    kept = reachability.reached(edges, parts.select("pkg_id"))
    things = inventory(sound).union(defined.select("pkg_id", F.lit("style"), "style_id"))
    things = things.union(rels.select("pkg_id", F.lit("rel"), F.concat_ws(reachability.SEPARATOR, "source_file", "rid")))
    things = things.union(parts.where(~F.col("part").endswith(".rels") & (F.col("part") != "[Content_Types].xml")).select("pkg_id", F.lit("part").alias("kind"), "part"))
    return reachability.orphans(things.distinct(), kept)


def previous_siblings(nodes: DataFrame) -> DataFrame:
    """Each element with the one before it under the same parent; null for a first child."""
    return nodes.select("pkg_id", "part", "node_id", "name", "tag", "previous_id", "previous_tag")


def style_clean(parts: DataFrame) -> Cleaned:
    """Removes definitions that nothing reaches, but for protected names and defaults."""
    parts = materialize(parts, "parts")
    looked = parts.where(P.style_part(F.col("part")) | (F.col("part") == STYLES))
    nodes = materialize(P.shred(looked, (*STYLE_NAMES, *STYLE_REFERENCES), STYLE_COLUMNS), "nodes")
    defined = style_definitions(nodes)
    status = styles.style_status(defined, styles.closure(defined, style_references(nodes, everywhere=True)))
    cuts = materialize(status.where("status = 'unused'").select("pkg_id", F.lit("word/styles.xml").alias("part"), "b0", "b1"), "cuts")
    return Cleaned(P.splice(parts, cuts), status, cuts, source=parts)


def relationships(nodes: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return nodes.where(F.col("part").endswith(".rels") & F.col("tag").endswith("Relationship")).select(
        "pkg_id", F.col("part").alias("source_file"), a["Id"].alias("rid"), F.coalesce(a["Target"], F.lit("")).alias("target"), F.coalesce(a["Type"], F.lit("")).alias("type"),
        F.coalesce(a["TargetMode"], F.lit("Internal")).alias("target_mode"), "b0", "b1",
    )


def defined_relationships(nodes: DataFrame) -> DataFrame:
    """One row for each file and id: the last definition counts."""
    rows = nodes.transform(relationships).withColumn("rid", F.coalesce("rid", F.lit("")))
    rest = ("target", "type", "target_mode")
    return rows.groupBy("pkg_id", "source_file", "rid").agg(F.max_by(F.struct(*rest), "b0").alias("r")).select("pkg_id", "source_file", "rid", *(F.col(f"r.{c}").alias(c) for c in rest))


def media(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part").rlike("^word/media/[^/]+$")).select("pkg_id", "part", F.col("size").alias("size_bytes"))


def element_test(operation: str, compat: str, safe: bool) -> Column | None:
    """Which elements go whole by one operation, where each can be told by itself; null for other operations.

    name is an element's name with its namespace, tag without; each operation looks at the one that it is defined on.
    """
    name, tag, part = F.col("name"), F.col("tag"), F.col("part")
    if operation == "rsid_registry":
        return (part == deep.SETTINGS) & (name == "w:rsids")
    if operation == "empty":
        full = [f"w:{t}" for t in RUN_CONTENT_TAGS]
        others = ("footnoteReference", "endnoteReference", "commentReference", "noBreakHyphen", "softHyphen", "delText", "pgNum", "AlternateContent") if safe else ()
        content = F.exists("children", lambda c: c.isin(full) | F.substring_index(c, ":", -1).isin(list(others)))
        return (name == "w:r") & part.rlike(r"^word/(document|(header|footer)[123])\.xml$") & ~content
    if operation == "fonts":
        script = F.coalesce(F.col("attrs")["script"], F.lit(""))
        return (tag == "font") & part.rlike(r"^word/theme/[^/]+\.xml$") & (script != "") & ~F.lower(script).isin(list(KEPT_SCRIPTS))
    if operation == "compat":
        inside = tag.isin(list(COMPAT_CLEAN_TAGS)) & (F.col("up") == "w:compat")
        return (part == deep.SETTINGS) & (name == "w:compat" if compat == "aggressive" else inside)
    if operation == "proof":
        return deep.proof_cleaned(part, tag) & ((part != deep.DOCUMENT) | (name == "w:proofErr"))
    return None


def deep_cuts(parts: DataFrame, nodes: DataFrame, operation: str, domains: Sequence[str] = (), compat: str = "default", safe: bool = False) -> DataFrame:
    """The spans that one operation removes from XML parts."""
    name, tag, part, a = F.col("name"), F.col("tag"), F.col("part"), F.col("attrs")
    span = [F.col(c) for c in SPAN]
    test = element_test(operation, compat, safe)
    if test is not None:
        return nodes.where(test).select(*span)
    if operation == "styles":
        lost = styles.orphaned_styles(style_definitions(nodes, deep=True), style_references(nodes, everywhere=False))
        return lost.select("pkg_id", F.lit("word/styles.xml").alias("part"), "b0", "b1")
    if operation == "bookmarks":
        main = nodes.where(part == deep.DOCUMENT)
        bm_id = F.coalesce(a["w:id"], F.lit("")).alias("id")
        begun = main.where((name == "w:bookmarkStart") & deep.internal_bookmark(a["w:name"])).select(*span, bm_id)
        ended = main.where(name == "w:bookmarkEnd").select(*span, bm_id).join(begun.select("pkg_id", "id").distinct(), ["pkg_id", "id"], "left_semi")
        return begun.select(*SPAN).union(ended.select(*SPAN))
    if operation == "links":
        rels = relationships(nodes.where((name == "rel:Relationship") & (F.col("depth") == 1)))
        gone = rels.where(deep.vendor_link(F.col("target"), F.col("type"), F.col("target_mode"), domains))
        owner = gone.select("pkg_id", deep.owning_part(F.col("source_file")).alias("part"), "rid").where(F.col("part").isNotNull())
        wrapped = nodes.where(name == "w:hyperlink").withColumn("rid", a["r:id"]).join(owner, ["pkg_id", "part", "rid"], "left_semi")
        opening = wrapped.select("pkg_id", "part", "b0", F.col("open_end").alias("b1"), F.lit("unwrapped").alias("what"))
        closing = wrapped.select("pkg_id", "part", F.col("close_start").alias("b0"), "b1", F.lit("closing"))
        return gone.select("pkg_id", F.col("source_file").alias("part"), "b0", "b1", F.lit("links").alias("what")).union(opening).union(closing).where("b0 < b1")
    if operation == "link_cache":
        named = F.lower(F.decode(F.substring("data", F.col("b0").cast("int") + 1, (F.col("b1") - F.col("b0")).cast("int")), "UTF-8"))
        cached = nodes.where((part == APP) & (tag == "HLinks")).join(parts.where(part == APP).select("pkg_id", "data"), "pkg_id")
        return cached.where(any_of([F.contains(named, F.lit(d.lower())) for d in domains])).select(*span)
    raise ValueError(f"unknown operation {operation}")


def deep_clean(parts: DataFrame, operations: Sequence[str] = OPERATIONS, domains: Sequence[str] = (), compat: str = "default", safe: bool = False, stored: bool = False) -> Cleaned:
    """Removes unreferenced media and styles and markup cruft; links only where domains are given. Parts that aren't well formed stay.

    detections: pkg_id, operation, n and size (of media) of what was removed. faults: pkg_id and fault of packages whose
    structure isn't sound. stored: what remains is stored, for a caller that needs both it and the detections.
    """
    unknown = set(operations) - set(OPERATIONS)
    if unknown:
        raise ValueError(f"unknown operations {sorted(unknown)}")
    parts = materialize(parts, "parts")
    nodes = materialize(P.shred(parts, DEEP_NAMES, DEEP_COLUMNS), "nodes")
    left, cuts = parts, parts.sparkSession.createDataFrame([], "pkg_id string, part string, b0 bigint, b1 bigint, operation string")
    blocks = {"compat": "compat_blocks"} if compat == "aggressive" else {}
    tests = {operation: element_test(operation, compat, safe) for operation in operations}
    tests = [F.when(test, F.lit(blocks.get(operation, operation))) for operation, test in tests.items() if test is not None]
    if tests:
        cuts = cuts.unionByName(nodes.select(*SPAN, F.explode(F.array(*tests)).alias("operation")).where(F.col("operation").isNotNull()))
    for operation in operations:
        if operation in ("media", "rsids") or (operation == "links" and not domains) or element_test(operation, compat, safe) is not None:
            continue
        name = F.col("what") if operation == "links" else F.lit(operation)
        cuts = cuts.unionByName(deep_cuts(parts, nodes, operation, domains, compat, safe).withColumn("operation", name).select(*SPAN, "operation"))
        if operation == "links":
            cuts = cuts.unionByName(deep_cuts(parts, nodes, "link_cache", domains).withColumn("operation", F.lit("link_cache")))
    cuts = materialize(cuts, "cuts")
    counts = cuts.groupBy("pkg_id", "operation").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("size"))
    if "media" in operations:
        lost = materialize(deep.orphaned_media(media(parts), defined_relationships(nodes)), "lost")
        left = left.join(lost.select("pkg_id", "part"), ["pkg_id", "part"], "left_anti").select(*parts.columns)
        counts = counts.union(lost.groupBy("pkg_id").agg(F.lit("media"), F.count("*"), F.sum("size_bytes")).select("pkg_id", "media", "count(1)", "sum(size_bytes)"))
    marks = RSID_STRIP if "rsids" in operations else None
    cuts = cuts.withColumn("first", F.col("operation") == "styles")  # marks of removed definitions aren't counted
    source, left = left, P.splice(left, cuts, marks)
    if marks:
        left = materialize(left, "left") if stored else left
        counts = counts.union(left.groupBy("pkg_id").agg(F.lit("rsids"), F.sum("n_marks").alias("n"), F.lit(0).cast("bigint")).where("n > 0"))
        left = left.drop("n_marks")
    return Cleaned(left, counts, cuts, validate(parts, nodes).where(F.col("fault").isNotNull()), source, marks)


#: Counters of a deep clean: what an operation's count is called, and the bytes that one removal is taken to save. Fixed values.
COUNTERS = {
    "media": ("media_removed", 0),
    "styles": ("styles_removed", 0),
    "rsids": ("rsids_removed", 25),
    "rsid_registry": ("rsid_registry_removed", 500),
    "empty": ("empty_elements_removed", 20),
    "fonts": ("font_mappings_removed", 60),
    "compat": ("compat_settings_removed", 50),
    "compat_blocks": ("compat_elements_removed", 200),
    "links": ("external_link_rels_removed", 200),
    "unwrapped": ("hyperlink_elements_unwrapped", 0),
    "link_cache": ("app_hlinks_removed", 10_000),
    "bookmarks": ("bookmarks_removed", 80),
    "proof": ("proof_elements_removed", 40),
}


def counters(parts: DataFrame, cleaned: Cleaned) -> DataFrame:
    """A row for each package: what a deep clean removed, bytes_saved, success and errors.

    A start and an end are one bookmark; the link cache counts once; media save their size.
    """
    n = {op: F.coalesce(F.sum(F.when(F.col("operation") == op, F.col("n"))), F.lit(0)) for op in COUNTERS}
    n["bookmarks"] = F.floor(n["bookmarks"] / 2)
    n["link_cache"] = F.least(n["link_cache"], F.lit(1))
    saved = F.coalesce(F.sum("size"), F.lit(0))
    for op, (_, weight) in COUNTERS.items():
        saved = saved + n[op] * weight
    found = cleaned.detections.groupBy("pkg_id").agg(*(n[op].cast("bigint").alias(name) for op, (name, _) in COUNTERS.items()), saved.cast("bigint").alias("bytes_saved"))
    every = parts.select("pkg_id").distinct().join(found, "pkg_id", "left").join(cleaned.faults, "pkg_id", "left")
    columns = [F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != "pkg_id"]
    return every.select("pkg_id", *columns, F.col("fault").isNull().alias("success"), F.concat_ws("; ", "fault", F.when(F.col("fault").isNotNull(), "Document structure validation failed")).alias("errors"))


STAGES = ("shallow", "styles", "deep")


def clean(packages: DataFrame, stages: Sequence[str] = STAGES, rules: Rules = DEFAULT, **deep_options: object) -> DataFrame:
    """Packages through several cleans in their order, with a row for each: pkg_id, content, success, errors and counts.

    The counts are what each stage took: paragraphs_and_runs, styles, and the savings of the deep clean (bytes_saved). A
    package that can't be read, or isn't sound for a stage, has its errors; it goes through the other stages, and its
    content is what came in where it can't be written back.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    parts = materialize(P.unpack(packages), "unpacked")
    faults = [parts.where("part IS NULL").select("pkg_id", F.col("error").alias("fault"))]
    counts = []
    for stage in stages:
        if stage == "deep":
            done = deep_clean(parts, stored=True, **deep_options)
            found = counters(parts, done)
            counts.append(found.select("pkg_id", F.lit("bytes_saved").alias("what"), F.col("bytes_saved").alias("n")))
            faults.append(found.where("NOT success").select("pkg_id", F.col("errors").alias("fault")))
        else:
            done = shallow_clean(parts, rules) if stage == "shallow" else style_clean(parts)
            what = "paragraphs_and_runs" if stage == "shallow" else "styles"
            counts.append(done.cuts.groupBy("pkg_id").agg(F.count("*").alias("n")).select("pkg_id", F.lit(what).alias("what"), "n"))
            if done.faults is not None:
                faults.append(done.faults.select("pkg_id", F.concat_ws(": ", "part", "error").alias("fault")))
        parts = materialize(done.parts.select("pkg_id", "part", "ord", "size", "data", "error"), stage)
    summed = reduce(DataFrame.union, counts).groupBy("pkg_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("paragraphs_and_runs", "styles", "bytes_saved")))
    written = P.pack(parts, packages)
    faults.append(written.where("error IS NOT NULL").select("pkg_id", F.col("error").alias("fault")))
    listed = reduce(DataFrame.union, faults).groupBy("pkg_id").agg(F.array_join(F.sort_array(F.collect_set("fault")), "; ").alias("errors"))
    joined = written.select("pkg_id", "content").join(summed, "pkg_id", "left").join(listed, "pkg_id", "left")
    return joined.select("pkg_id", "content", F.col("errors").isNull().alias("success"), F.coalesce("errors", F.lit("")).alias("errors"), *(F.coalesce(c, F.lit(0)).alias(c) for c in summed.columns[1:]))


VALIDATED = ("[Content_Types].xml", "_rels/.rels", deep.DOCUMENT)  # parts whose presence or form is looked at


def validate(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first structural fault of each package; null if there is none."""
    broken = nodes.where(F.col("error").isNotNull()).select("pkg_id", "part").distinct().withColumn("_broken", F.lit(True))
    joined = parts.select("pkg_id", "part", F.lit(None).cast("boolean").alias("_broken")).union(broken)
    there = lambda p: F.bool_or(F.col("part") == p)
    bad = lambda p: F.bool_or((F.col("part") == p) & F.coalesce("_broken", F.lit(False)))
    fault = (
        F.when(~there("[Content_Types].xml"), "Missing [Content_Types].xml")
        .when(bad("[Content_Types].xml"), "Invalid [Content_Types].xml")
        .when(~there("_rels/.rels"), "Missing _rels/.rels")
        .when(~there(deep.DOCUMENT), "Missing word/document.xml")
        .when(bad(deep.DOCUMENT), "Invalid word/document.xml")
    )
    return joined.groupBy("pkg_id").agg(fault.alias("fault"))
