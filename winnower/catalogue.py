"""The queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower import rules as R
from winnower.functions.extension import register_detector
from winnower.functions.scratch import new_folder
from winnower.functions.text import first_hit, lowered, matches, matches_any, once
from winnower.operators import containment, deep, detect, diagnose, html, report, ruletable, styles, textindex
from winnower.plans.views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# SQL builders


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hit(pattern: str, column: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)}, 'is')"


def any_hit(patterns: Sequence[str], column: str) -> str:
    return "(" + " OR ".join(hit(p, column) for p in patterns) + ")"


def first_hit_sql(patterns: Sequence[str], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(p, column)} THEN {quoted(p)}" for p in patterns) + " END"


def count_hits(patterns: Sequence[str], column: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {hit(p, column)} THEN 1 ELSE 0 END" for p in patterns) + ")"


def listed(values: Sequence[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


PREVIEW = "replace(replace(CASE WHEN length(txt) > 80 THEN concat(substr(txt, 1, 80), '...') ELSE txt END, chr(10), '↵'), chr(13), '')"
SOLID = r"regexp_matches({0}, '\S')"
STYLES = listed(R.DEFAULT.styles)


def scores(source: str, keys: str, run: bool) -> tuple[str, ...]:
    """Scores of every detector as columns, then a row for each detection, under the names scored and found."""
    style = "rstyle" if run else "pstyle"
    formatting = f" + CASE WHEN italic THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN upper(color) IN {listed(R.SIGNAL_COLORS)} THEN 0.3::DOUBLE ELSE 0 END" if run else ""
    spec = f"(CASE WHEN {any_hit(R.SPECIFIER_PATTERNS, 'txt')} THEN 0.6::DOUBLE ELSE 0 END{formatting} + CASE WHEN {style} IN {STYLES} THEN 0.8::DOUBLE ELSE 0 END)"
    hidden = "CASE WHEN hidden THEN 1.0::DOUBLE END" if run else "NULL::DOUBLE"
    scored = f"""scored AS (
      SELECT *, CASE WHEN solid AND {any_hit(R.PRESERVE_PATTERNS, 'txt')} THEN 1.0::DOUBLE END AS c_preserve,
        CASE WHEN solid AND {spec} >= 0.5 THEN least({spec}, 1.0::DOUBLE) END AS c_specifier_note,
        CASE WHEN solid THEN CASE WHEN {count_hits(R.COPYRIGHT_PATTERNS, 'txt')} >= 2 THEN 1.0::DOUBLE WHEN {count_hits(R.COPYRIGHT_PATTERNS, 'txt')} = 1 THEN 0.7::DOUBLE END END AS c_copyright,
        {hidden} AS c_hidden_text,
        CASE WHEN solid AND {any_hit(R.VENDOR_PATTERNS, 'txt')} THEN 1.0::DOUBLE END AS c_specagent,
        CASE WHEN solid AND {any_hit(R.EDITORIAL_PATTERNS, 'txt')} THEN 0.8::DOUBLE END AS c_editorial_artifact
      FROM (SELECT *, {SOLID.format('txt')} AS solid FROM {source}))"""
    parts = [f"SELECT {keys}, txt, -1 AS ord, 'preserve' AS content_type, c_preserve AS confidence FROM scored WHERE c_preserve IS NOT NULL"]
    for i, kind in enumerate(R.CONTENT_TYPES[:5]):
        parts.append(f"SELECT {keys}, txt, {i} AS ord, '{kind}', c_{kind} FROM scored WHERE c_preserve IS NULL AND c_{kind} IS NOT NULL")
    return scored, f"found AS ({' UNION ALL '.join(parts)})"


PARAGRAPHS = scores("spec_lines", "doc_id, pos", run=False)
RUNS = scores("spec_runs", "doc_id, pos, run", run=True)


def paragraphs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(detect.with_detections(view(spark, sf_dir, "spec_lines"), detect.paragraph_element()))


def runs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(detect.with_detections(view(spark, sf_dir, "spec_runs"), detect.run_element()))


# Detectors


def one_detector(kind: str) -> None:
    run = kind == "hidden_text"
    keys = "doc_id, pos, run" if run else "doc_id, pos"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = runs_found(spark, sf_dir) if run else paragraphs_found(spark, sf_dir)
        return found.where(F.col("content_type") == kind).select(*keys.split(", "), F.round("confidence", 4).alias("confidence"))

    name = {"specagent": "detect_vendor_ref"}.get(kind, f"detect_{kind}")
    QUERIES[name] = f
    ORACLE_SQL[name] = oracle(("spec_runs",) if run else ("spec_lines",), f"SELECT {keys}, round(confidence, 4) AS confidence FROM found WHERE content_type = '{kind}'", RUNS if run else PARAGRAPHS)


for _kind in R.CONTENT_TYPES:
    one_detector(_kind)


@query(oracle(("spec_lines",), "SELECT content_type, count(*) AS n, count(DISTINCT doc_id) AS docs, round(sum(confidence), 4) AS sum_conf FROM found GROUP BY content_type ORDER BY content_type", PARAGRAPHS))
def detection_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by_type(paragraphs_found(spark, sf_dir))


@query(oracle(("lines",), f"SELECT doc_id, pos, line FROM lines WHERE {any_hit(R.COPYRIGHT_PATTERNS, 'line')}"))
def detect_native_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    lines = view(spark, sf_dir, "lines").withColumn("low", lowered(line))
    return lines.where(matches_any(line, R.COPYRIGHT_PATTERNS, F.col("low"))).drop("low")


@query(oracle(("spec_lines",), "SELECT doc_id, count(*) FILTER (content_type <> 'preserve') AS removed, count(*) FILTER (content_type = 'preserve') AS preserved FROM found GROUP BY doc_id", PARAGRAPHS))
def removed_vs_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.removed_and_preserved(paragraphs_found(spark, sf_dir))


@query(oracle(("spec_runs",), "SELECT doc_id, pos, run, content_type, round(confidence, 4) AS confidence FROM found", RUNS))
def run_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_found(spark, sf_dir).select("doc_id", "pos", "run", "content_type", F.round("confidence", 4).alias("confidence"))


SHORT = "CASE WHEN length(txt) > 50 THEN concat(substr(txt, 1, 50), '...') ELSE txt END"


@query(oracle(("spec_lines",), f"SELECT doc_id, pos, format('Detection({{}}, ''{{}}'', conf={{:.2f}})', content_type, {SHORT}, confidence) AS shown FROM found", PARAGRAPHS))
def detection_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs_found(spark, sf_dir).select("doc_id", "pos", report.shown(F.col("content_type"), F.col("txt"), F.col("confidence")).alias("shown"))


@query(oracle(("spec_lines",), "SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (NOT regexp_matches(txt, '\\S')) AS blank FROM spec_lines GROUP BY doc_id"))
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.paragraph_counts(view(spark, sf_dir, "spec_lines"))


CONFIG = {
    "specifier_notes": {"enabled": False},
    "editorial_artifacts": {"text_patterns": [R.EDITORIAL_PATTERNS[0], r"\[tbd\]"]},
    "style_based_detection": {"paragraph_styles": ["CMT"]},
}


@query(oracle(("spec_lines",), f"SELECT 'editorial_artifact' AS content_type, count(*) AS n, count(DISTINCT doc_id) AS docs, round(sum(0.8::DOUBLE), 4) AS sum_conf FROM spec_lines WHERE {SOLID.format('txt')} AND {any_hit(CONFIG['editorial_artifacts']['text_patterns'], 'txt')} HAVING count(*) > 0"))
def detection_counts_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a configuration: a section that is off, one with patterns of its own, and the rest left out."""
    lines = view(spark, sf_dir, "spec_lines")
    return report.counts_by_type(detect.exploded(detect.with_detections(lines, detect.paragraph_element(), R.from_config(CONFIG))))


@query(oracle(("spec_lines",), f"SELECT doc_id, pos FROM spec_lines WHERE length(txt) > 300 AND NOT {any_hit(R.PRESERVE_PATTERNS, 'txt')}"))
def detect_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of one's own beside the built-in ones."""
    long = ("long_line", lambda e: (F.when(F.length(e.text) > 300, F.lit(0.9)), F.lit("longer than 300 characters")))
    found = detect.exploded(detect.with_detections(view(spark, sf_dir, "spec_lines"), detect.paragraph_element(), custom=(long,)))
    return found.where("content_type = 'long_line'").select("doc_id", "pos")


@query(oracle(("spec_lines",), "SELECT doc_id, pos, 'long_line' AS content_type, 0.9::DOUBLE AS confidence, concat('longer than 300 characters: ', length(txt)) AS reason FROM spec_lines WHERE length(txt) > 300"))
def detect_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table function of SQL, joined back to nothing: it carries the line's key."""
    register_detector(spark, "long_line", lambda texts: [(0.9, f"longer than 300 characters: {len(t)}") if t is not None and len(t) > 300 else None for t in texts], "struct<doc_id:bigint,pos:bigint>")
    view(spark, sf_dir, "spec_lines").createOrReplaceTempView("_lines")
    return spark.sql("SELECT k.doc_id, k.pos, content_type, confidence, reason FROM long_line(TABLE(SELECT struct(doc_id, pos) AS k, txt FROM _lines))")


# Decisions

DECISION = (
    *(c.replace("scored AS", "p_scored AS").replace("FROM scored", "FROM p_scored").replace("found AS", "p_found AS") for c in PARAGRAPHS),
    *RUNS,
    """p_sum AS (SELECT l.doc_id, l.pos, count(f.ord) AS own_detections, coalesce(bool_or(f.content_type = 'preserve'), FALSE) AS kept,
        coalesce(bool_or(f.content_type <> 'preserve' AND f.confidence >= 0.5), FALSE) AS hit
      FROM spec_lines l LEFT JOIN p_found f ON l.doc_id = f.doc_id AND l.pos = f.pos GROUP BY l.doc_id, l.pos)""",
    r"""r_each AS (SELECT r.doc_id, r.pos, r.run, count(f.ord) AS n, coalesce(bool_or(f.content_type = 'preserve'), FALSE) AS kept,
        coalesce(bool_or(f.content_type <> 'preserve' AND f.confidence >= 0.5), FALSE) AS hit
      FROM spec_runs r LEFT JOIN found f ON r.doc_id = f.doc_id AND r.pos = f.pos AND r.run = f.run
      WHERE regexp_matches(r.txt, '\S') GROUP BY r.doc_id, r.pos, r.run)""",
    "r_sum AS (SELECT doc_id, pos, sum(n) AS n, bool_or(kept) AS kept, bool_and(hit AND NOT kept) AS every FROM r_each GROUP BY doc_id, pos)",
    """decided AS (SELECT p.doc_id, p.pos, CAST(own_detections AS BIGINT) AS own_detections, p.kept OR p.hit AS settled,
        CAST(CASE WHEN p.kept OR p.hit THEN 0 ELSE coalesce(r.n, 0) END AS BIGINT) AS run_detections,
        CASE WHEN p.kept THEN 'whitelisted' WHEN p.hit THEN 'paragraph' WHEN r.kept THEN 'run whitelisted' WHEN r.every THEN 'all runs' ELSE 'kept' END AS decision
      FROM p_sum p LEFT JOIN r_sum r ON p.doc_id = r.doc_id AND p.pos = r.pos)""",
)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.decide(view(spark, sf_dir, "spec_lines"), view(spark, sf_dir, "spec_runs"), ("doc_id", "pos"))


@query(oracle(("spec_runs",), "SELECT doc_id, pos, own_detections, run_detections, decision, decision IN ('paragraph', 'all runs') AS removed FROM decided", DECISION))
def paragraph_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).drop("settled")


@query(oracle(("spec_runs",), "SELECT doc_id, pos, run_detections AS detected FROM decided WHERE decision IN ('kept', 'run whitelisted') AND run_detections > 0", DECISION))
def detected_not_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = ~F.col("removed") & ~F.col("settled") & (F.col("run_detections") > 0)
    return decided(spark, sf_dir).where(stays).select("doc_id", "pos", F.col("run_detections").alias("detected"))


@query(oracle(("spec_runs",), "SELECT doc_id, pos, run, count(*) AS detections, bool_or(confidence >= 0.5) AND NOT bool_or(content_type = 'preserve') AS removed FROM found JOIN (SELECT doc_id, pos, run, parent_is_p FROM spec_runs) USING (doc_id, pos, run) WHERE NOT parent_is_p GROUP BY doc_id, pos, run", RUNS))
def loose_run_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = detect.loose_runs(view(spark, sf_dir, "spec_runs")).where(F.size("found") > 0)
    return loose.select("doc_id", "pos", "run", F.size("found").cast("bigint").alias("detections"), detect.removable(F.col("found")).alias("removed"))


@query(
    oracle(
        ("spec_lines",),
        "SELECT doc_id, string_agg(txt, chr(10) ORDER BY pos) AS clean FROM spec_lines l WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = l.doc_id AND f.pos = l.pos AND f.content_type <> 'preserve') GROUP BY doc_id",
        PARAGRAPHS,
    )
)
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = detect.with_detections(view(spark, sf_dir, "spec_lines"), detect.paragraph_element())
    left = lines.where(~detect.removable(F.col("found"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "txt"))).alias("kept"))
    return left.select("doc_id", F.array_join(F.col("kept.txt"), "\n").alias("clean"))


@query(
    oracle(
        ("spec_lines",),
        f"SELECT * FROM (SELECT doc_id, pos, {first_hit_sql(R.EDITORIAL_PATTERNS, 'txt')} AS editorial, {first_hit_sql(R.VENDOR_PATTERNS, 'txt')} AS vendor, {first_hit_sql(R.PRESERVE_PATTERNS, 'txt')} AS preserve FROM spec_lines) WHERE coalesce(editorial, vendor, preserve) IS NOT NULL",
    )
)
def first_match_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, low = F.col("txt"), F.col("low")
    kinds = {"editorial": R.EDITORIAL_PATTERNS, "vendor": R.VENDOR_PATTERNS, "preserve": R.PRESERVE_PATTERNS}
    hits = F.struct(*(first_hit(text, patterns, low).alias(kind) for kind, patterns in kinds.items()))
    lines = once(view(spark, sf_dir, "spec_lines").withColumn("low", lowered(text)), "hits", hits)
    return lines.where(F.coalesce("hits.editorial", "hits.vendor", "hits.preserve").isNotNull()).select("doc_id", "pos", "hits.*")


@query(
    oracle(
        ("spec_lines",),
        "SELECT doc_id, pos, n_hits, concat_ws('; ', "
        + ", ".join(f"CASE WHEN {hit(p, 'txt')} THEN {quoted('Pattern match: ' + p)} END" for p in R.COPYRIGHT_PATTERNS)
        + ", CASE WHEN n_hits >= 2 THEN concat('Multiple indicators: ', n_hits) END) AS reason FROM (SELECT *, CAST("
        + count_hits(R.COPYRIGHT_PATTERNS, "txt")
        + f" AS BIGINT) AS n_hits FROM spec_lines) WHERE n_hits > 0 AND NOT {any_hit(R.PRESERVE_PATTERNS, 'txt')}",
    )
)
def multi_match_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs_found(spark, sf_dir).where("content_type = 'copyright'")
    total = F.regexp_extract("reason", r"Multiple indicators: (\d+)$", 1)
    return found.select("doc_id", "pos", F.when(total == "", 1).otherwise(total.cast("bigint")).cast("bigint").alias("n_hits"), "reason")


ALL_PATTERNS = [(section, i, p) for section, part in R.DEFAULT.sections.items() for i, p in enumerate(part.patterns)]


@query(oracle(("spec_lines",), " UNION ALL ".join(f"SELECT {quoted(s)} AS section, CAST({i} AS BIGINT) AS seq, count(*) AS lines FROM spec_lines WHERE {hit(p, 'txt')} HAVING count(*) > 0" for s, i, p in ALL_PATTERNS)))
def pattern_hit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the lines: each line lists the patterns that it matches."""
    text, low = F.col("txt"), F.col("low")
    hits = F.array(*(F.when(matches(text, p, low), F.struct(F.lit(s).alias("section"), F.lit(i).cast("bigint").alias("seq"))) for s, i, p in ALL_PATTERNS))
    found = once(view(spark, sf_dir, "spec_lines").withColumn("low", lowered(text)), "hits", hits)
    lines = found.select(F.inline_outer("hits")).where(F.col("section").isNotNull())
    return lines.groupBy("section", "seq").agg(F.count("*").alias("lines"))


#: The fixed rules as a table.
RULE_ROWS = [(s, i, p) for s, i, p in ALL_PATTERNS]
#: The same, and one literal rule for each document: a table of rules that grows with the corpus.
GROWN = f"""fixed AS ({" UNION ALL ".join(f"SELECT doc_id, pos, {quoted(s)} AS section, CAST({i} AS BIGINT) AS seq, {quoted(p)} AS pattern FROM spec_lines WHERE {hit(p, 'txt')}" for s, i, p in ALL_PATTERNS)}),
  grown AS (SELECT doc_id, pos, 'phrases' AS section, seq, pattern FROM spec_lines JOIN spec_rules ON contains(lower(txt), pattern)), every_hit AS (SELECT * FROM fixed UNION ALL SELECT * FROM grown)"""


def lines_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = spark.createDataFrame(RULE_ROWS, "section string, seq bigint, pattern string")
    grown = view(spark, sf_dir, "spec_rules").select(F.lit("phrases").alias("section"), "seq", "pattern")
    return view(spark, sf_dir, "spec_lines"), rules.union(grown)


@query(oracle(("spec_lines", "spec_rules"), "SELECT section, seq, count(*) AS lines FROM every_hit GROUP BY section, seq", (GROWN,)))
def rule_table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruletable.line_counts(*lines_and_rules(spark, sf_dir), ("doc_id", "pos"))


@query(oracle(("spec_lines", "spec_rules"), "SELECT doc_id, pos, section, min(seq) AS seq, arg_min(pattern, seq) AS pattern, count(*) AS n_hits FROM every_hit GROUP BY doc_id, pos, section", (GROWN,)))
def rule_table_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruletable.first_hits(ruletable.class_hits(*lines_and_rules(spark, sf_dir), ("doc_id", "pos")), ("doc_id", "pos"))


# Containment

#: Each element with each one above it, by walking up from parent to parent.
WALK = """walk(pkg_id, part, node_id, tag, above) AS (SELECT pkg_id, part, node_id, tag, parent_id FROM spec_tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT w.pkg_id, w.part, w.node_id, w.tag, t.parent_id FROM walk w JOIN spec_tree t ON w.pkg_id = t.pkg_id AND w.above = t.node_id WHERE t.parent_id IS NOT NULL),
  above AS (SELECT w.pkg_id, w.part, w.node_id AS descendant, w.tag, w.above AS ancestor, t.tag AS up FROM walk w JOIN spec_tree t ON w.pkg_id = t.pkg_id AND w.above = t.node_id)"""


@query(oracle(("spec_tree",), "SELECT pkg_id, part, ancestor, descendant FROM above WHERE up = 'tbl' AND tag = 'tc'", (WALK,), recursive=True))
def cells_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = view(spark, sf_dir, "spec_tree")
    return containment.contained(tree.where("tag = 'tbl'"), tree.where("tag = 'tc'"))


@query(oracle(("spec_tree",), "SELECT pkg_id, part, descendant, max(ancestor) AS ancestor, count(*) AS depth FROM above WHERE up IN ('txbxContent', 'tbl') AND tag = 't' AND part LIKE 'word/header%' GROUP BY pkg_id, part, descendant", (WALK,), recursive=True))
def innermost_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of headers that lie in a text box or a table, with the innermost one."""
    tree = view(spark, sf_dir, "spec_tree").where(F.col("part").startswith("word/header"))
    return containment.nearest(containment.contained(tree.where("tag IN ('txbxContent', 'tbl')"), tree.where("tag = 't'")))


# Styles

EDGES = ("edges AS (SELECT pkg_id, style_id AS src, 'basedOn' AS kind, based_on AS dst FROM spec_styles WHERE based_on IS NOT NULL UNION ALL SELECT pkg_id, style_id, 'link', linked FROM spec_styles WHERE linked IS NOT NULL UNION ALL SELECT pkg_id, style_id, 'next', next_style FROM spec_styles WHERE next_style IS NOT NULL)",)
CLOSURE = (*EDGES, "reached(pkg_id, style_id) AS (SELECT pkg_id, style_id FROM spec_style_refs UNION SELECT e.pkg_id, e.dst FROM reached r JOIN edges e ON r.pkg_id = e.pkg_id AND r.style_id = e.src)")
DEEP = (*CLOSURE, f"deep AS (SELECT pkg_id, style_id FROM reached UNION SELECT pkg_id, style_id FROM (SELECT DISTINCT pkg_id FROM spec_styles), (SELECT unnest({list(R.ALWAYS_USED_STYLES)}) AS style_id))")
STATUS = (
    *CLOSURE,
    f"status AS (SELECT s.*, CASE WHEN r.style_id IS NOT NULL THEN 'used' WHEN s.style_id IN {listed(R.PROTECTED_STYLES)} OR s.is_default THEN 'protected' ELSE 'unused' END AS status FROM spec_styles s LEFT JOIN reached r ON s.pkg_id = r.pkg_id AND s.style_id = r.style_id)",
)
STYLE_VIEWS = ("spec_styles", "spec_style_refs")


def style_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "spec_styles"), view(spark, sf_dir, "spec_style_refs")


@query(oracle(("spec_styles",), "SELECT pkg_id, src, kind, dst FROM edges", EDGES))
def style_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.style_edges(view(spark, sf_dir, "spec_styles"))


@query(oracle(STYLE_VIEWS, "SELECT pkg_id, style_id FROM reached", CLOSURE, recursive=True))
def style_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.closure(*style_views(spark, sf_dir))


@query(oracle(STYLE_VIEWS, "SELECT pkg_id, style_id FROM deep", DEEP, recursive=True))
def style_closure_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.closure_with_defaults(*style_views(spark, sf_dir))


def style_status_query(status: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        defined, used = style_views(spark, sf_dir)
        return styles.style_status(defined, styles.closure(defined, used)).where(F.col("status") == status).select("pkg_id", "style_id")

    QUERIES[f"{status}_styles"] = f
    ORACLE_SQL[f"{status}_styles"] = oracle(STYLE_VIEWS, f"SELECT pkg_id, style_id FROM status WHERE status = '{status}'", STATUS, recursive=True)


style_status_query("unused")
style_status_query("protected")


@query(oracle(STYLE_VIEWS, "SELECT pkg_id, style_id FROM spec_styles s WHERE NOT EXISTS (SELECT 1 FROM deep d WHERE d.pkg_id = s.pkg_id AND d.style_id = s.style_id)", DEEP, recursive=True))
def orphaned_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.orphaned_styles(*style_views(spark, sf_dir)).select("pkg_id", "style_id")


@query(
    oracle(
        STYLE_VIEWS,
        "SELECT s.pkg_id, count(*) AS n_defined, (SELECT count(*) FROM reached r WHERE r.pkg_id = s.pkg_id) AS n_used, count(*) FILTER (status = 'unused') AS n_unused, count(*) FILTER (status = 'protected') AS n_protected FROM status s GROUP BY s.pkg_id",
        STATUS,
        recursive=True,
    )
)
def style_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.style_totals(*style_views(spark, sf_dir))


@query(
    oracle(
        STYLE_VIEWS,
        "SELECT s.pkg_id, CAST(to_json({'n_defined': count(*), 'n_used': (SELECT count(*) FROM reached r WHERE r.pkg_id = s.pkg_id), 'n_unused': count(*) FILTER (status = 'unused'), 'n_protected': count(*) FILTER (status = 'protected')}) AS VARCHAR) AS report FROM status s GROUP BY s.pkg_id",
        STATUS,
        recursive=True,
    )
)
def report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nested(styles.style_totals(*style_views(spark, sf_dir)))


# Parts, relationships, markup


@query(oracle(("spec_rels",), r"SELECT pkg_id, rid, CASE WHEN contains(source_file, '/_rels/') THEN regexp_replace(replace(source_file, '/_rels/', '/'), '\.rels$', '') END AS owner FROM spec_rels"))
def owning_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "spec_rels").select("pkg_id", "rid", deep.owning_part(F.col("source_file")).alias("owner"))


@query(
    oracle(
        ("spec_media", "spec_rels"),
        "SELECT pkg_id, part, size_bytes FROM spec_media m WHERE NOT EXISTS (SELECT 1 FROM spec_rels r WHERE r.pkg_id = m.pkg_id AND contains(r.target, 'media/') AND suffix(m.part, string_split(r.target, '/')[-1]))",
    )
)
def orphaned_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.orphaned_media(view(spark, sf_dir, "spec_media"), view(spark, sf_dir, "spec_rels"))


DOMAINS = ("vendor.example.com",)


@query(oracle(("spec_rels",), "SELECT pkg_id, rid, target FROM spec_rels WHERE coalesce(target_mode, 'Internal') = 'External' AND contains(type, 'relationships/hyperlink') AND contains(lower(target), 'vendor.example.com')"))
def vendor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = view(spark, sf_dir, "spec_rels")
    return rels.where(deep.vendor_link(F.col("target"), F.col("type"), F.col("target_mode"), DOMAINS)).select("pkg_id", "rid", "target")


INTERNAL = "(" + " OR ".join(f"starts_with(name, '{p}')" for p in R.BOOKMARK_PREFIXES) + ")"


@query(
    oracle(
        ("spec_nodes",),
        f"""SELECT pkg_id, node_id, tag, bm_id, CASE WHEN name = '_GoBack' THEN 'Cursor position bookmark' WHEN starts_with(name, '_Hlk') THEN 'Hyperlink anchor bookmark' ELSE 'Internal Word bookmark' END AS reason
        FROM spec_nodes WHERE part = 'word/document.xml' AND tag = 'bookmarkStart' AND {INTERNAL}
        UNION ALL SELECT pkg_id, node_id, tag, bm_id, NULL FROM spec_nodes WHERE part = 'word/document.xml' AND tag = 'bookmarkEnd' AND (pkg_id, bm_id) IN (SELECT (pkg_id, bm_id) FROM spec_nodes WHERE part = 'word/document.xml' AND tag = 'bookmarkStart' AND {INTERNAL})""",
    )
)
def bookmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.bookmark_pairs(view(spark, sf_dir, "spec_nodes"))


RSIDS = f"SELECT *, len(regexp_extract_all(xml, {quoted('(?i)' + R.RSID_SCAN)})) AS scanned, len(regexp_extract_all(xml, {quoted('(?i)' + R.RSID_STRIP)})) AS stripped, regexp_replace(xml, {quoted(R.RSID_STRIP)}, '', 'gi') AS clean FROM spec_xml"


@query(oracle(("spec_xml",), f"SELECT pkg_id, part, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(stripped) AS BIGINT) AS stripped FROM ({RSIDS}) GROUP BY ROLLUP (pkg_id, part)"))
def rsid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.rsid_counts(view(spark, sf_dir, "spec_xml")).rollup("pkg_id", "part").agg(F.sum("scanned").alias("scanned"), F.sum("stripped").alias("stripped"))


@query(oracle(("spec_xml",), f"SELECT pkg_id, seq, clean FROM ({RSIDS})"))
def rsid_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.rsid_counts(view(spark, sf_dir, "spec_xml")).select("pkg_id", "seq", "clean")


SCANNED_PROOF = "((part = 'word/settings.xml' AND tag IN ('proofState', 'proofErr', 'noProof')) OR (part = 'word/document.xml' AND tag = 'proofErr'))"
CLEANED_PROOF = SCANNED_PROOF.replace(", 'noProof'", "")


@query(oracle(("spec_nodes",), f"SELECT pkg_id, count(*) FILTER ({SCANNED_PROOF}) AS scanned, count(*) FILTER ({CLEANED_PROOF}) AS cleaned FROM spec_nodes GROUP BY pkg_id"))
def proof_scan_vs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, tag = F.col("part"), F.col("tag")
    return view(spark, sf_dir, "spec_nodes").groupBy("pkg_id").agg(F.count_if(deep.proof_scanned(part, tag)).alias("scanned"), F.count_if(deep.proof_cleaned(part, tag)).alias("cleaned"))


SCANNED_COMPAT = f"(tag IN {listed(R.COMPAT_SCAN_TAGS)} AND NOT (tag = 'compatSetting' AND contains(coalesce(name, ''), '{R.COMPAT_KEPT_NAME}')))"


@query(oracle(("spec_nodes",), f"SELECT pkg_id, count(*) FILTER ({SCANNED_COMPAT}) AS scanned, count(*) FILTER (tag IN {listed(R.COMPAT_CLEAN_TAGS)}) AS cleaned FROM spec_nodes WHERE part = 'word/settings.xml' AND parent_tag = 'compat' GROUP BY pkg_id"))
def compat_scan_vs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = view(spark, sf_dir, "spec_nodes").where((F.col("part") == deep.SETTINGS) & (F.col("parent_tag") == "compat"))
    return settings.groupBy("pkg_id").agg(F.count_if(deep.compat_scanned(F.col("tag"), F.col("name"))).alias("scanned"), F.count_if(deep.compat_cleaned(F.col("tag"))).alias("cleaned"))


EMPTY = f"CASE WHEN tag = 'r' AND coalesce(child_tag, '') NOT IN {listed(R.RUN_CONTENT_TAGS)} THEN 'empty_runs' WHEN tag = 'rPr' AND child_tag IS NULL THEN 'empty_rPr' END"


@query(oracle(("spec_nodes",), f"SELECT pkg_id, part, element, count(*) AS n FROM (SELECT *, {EMPTY} AS element FROM spec_nodes) WHERE element IS NOT NULL GROUP BY ALL"))
def empty_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "spec_nodes")
    bare = ~deep.has_content(F.array(F.coalesce("child_tag", F.lit(""))))
    kind = F.when((F.col("tag") == "r") & bare, "empty_runs").when((F.col("tag") == "rPr") & F.col("child_tag").isNull(), "empty_rPr")
    return nodes.withColumn("element", kind).where(F.col("element").isNotNull()).groupBy("pkg_id", "part", "element").agg(F.count("*").alias("n"))


THEMED = f"regexp_matches(part, '^word/theme/[^/]+[.]xml$') AND tag = 'font' AND coalesce(script, '') <> '' AND lower(script) NOT IN {listed(R.KEPT_SCRIPTS)}"


@query(oracle(("spec_nodes",), f"SELECT pkg_id, script, count(*) AS n FROM spec_nodes WHERE {THEMED} GROUP BY pkg_id, script"))
def font_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.font_mappings(view(spark, sf_dir, "spec_nodes")).groupBy("pkg_id", "script").agg(F.count("*").alias("n"))


@query(oracle(("spec_nodes",), f"SELECT pkg_id, part AS file, script, coalesce(typeface, '') AS typeface FROM spec_nodes WHERE {THEMED}"))
def font_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.font_mappings(view(spark, sf_dir, "spec_nodes"))


@query(
    oracle(
        ("spec_nodes",),
        f"SELECT pkg_id, CASE WHEN tag = 'compatSetting' THEN concat('compatSetting: ', coalesce(name, '')) ELSE tag END AS setting, CASE tag {' '.join(f'WHEN {quoted(t)} THEN {quoted(r)}' for t, r in deep.COMPAT_REASONS.items())} END AS reason FROM spec_nodes WHERE part = 'word/settings.xml' AND parent_tag = 'compat' AND {SCANNED_COMPAT}",
    )
)
def compat_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.compat_listed(view(spark, sf_dir, "spec_nodes"))


@query(
    oracle(
        (*STYLE_VIEWS, "spec_media", "spec_rels", "spec_xml", "spec_nodes"),
        "SELECT coalesce(m.pkg_id, s.pkg_id, x.pkg_id, n.pkg_id) AS pkg_id, CAST(coalesce(m.v, 0) + coalesce(s.v, 0) + coalesce(x.v, 0) + coalesce(n.v, 0) AS BIGINT) AS estimated_bytes FROM m FULL JOIN s ON m.pkg_id = s.pkg_id FULL JOIN x ON coalesce(m.pkg_id, s.pkg_id) = x.pkg_id FULL JOIN n ON coalesce(m.pkg_id, s.pkg_id, x.pkg_id) = n.pkg_id",
        (
            *DEEP,
            "m AS (SELECT pkg_id, sum(size_bytes) AS v FROM spec_media m WHERE NOT EXISTS (SELECT 1 FROM spec_rels r WHERE r.pkg_id = m.pkg_id AND contains(r.target, 'media/') AND suffix(m.part, string_split(r.target, '/')[-1])) GROUP BY pkg_id)",
            "s AS (SELECT pkg_id, 500 * count(*) AS v FROM spec_styles s WHERE NOT EXISTS (SELECT 1 FROM deep d WHERE d.pkg_id = s.pkg_id AND d.style_id = s.style_id) GROUP BY pkg_id)",
            f"x AS (SELECT pkg_id, 25 * sum(scanned) AS v FROM ({RSIDS}) GROUP BY pkg_id)",
            f"n AS (SELECT pkg_id, 20 * count(*) FILTER (part IN {listed(deep.EMPTY_SCANNED)} AND {EMPTY} IS NOT NULL) + 60 * count(*) FILTER ({THEMED}) + 50 * count(*) FILTER (part = 'word/settings.xml' AND parent_tag = 'compat' AND {SCANNED_COMPAT}) + 80 * count(*) FILTER (part = 'word/document.xml' AND tag = 'bookmarkStart' AND {INTERNAL}) + 40 * count(*) FILTER ({SCANNED_PROOF}) AS v FROM spec_nodes GROUP BY pkg_id)",
        ),
        recursive=True,
    )
)
def estimated_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = deep.orphaned_media(view(spark, sf_dir, "spec_media"), view(spark, sf_dir, "spec_rels"))
    return deep.estimated_savings(media, styles.orphaned_styles(*style_views(spark, sf_dir)), deep.rsid_counts(view(spark, sf_dir, "spec_xml")), view(spark, sf_dir, "spec_nodes"))


# Web pages


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def strip_query(name: str, pattern: str, other: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: html.strip(pages(spark, sf_dir), pattern)
    ORACLE_SQL[name] = f"SELECT page_id, CAST(len(regexp_extract_all(html, {quoted(other)})) AS BIGINT) AS removed, CAST(length(html) - length(regexp_replace(html, {quoted(other)}, '', 'g')) AS BIGINT) AS saved_chars FROM pages"


strip_query("html_attr_strip", html.CLASS_ATTRIBUTE, html.CLASS_ATTRIBUTE)
strip_query("html_comment_strip", html.COMMENT, html.COMMENT)
strip_query("html_empty_tags", html.EMPTY_TAG, "|".join(rf"<{t}>\s*</{t}>" for t in ("p", "b", "i", "em", "span", "div", "li", "td")))

HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(
    "WITH t AS (SELECT page_id, "
    + HOST.format("url")
    + f" AS own, unnest(regexp_extract_all(html, {quoted(html.ANCHOR)}, 1)) AS target FROM pages), h AS (SELECT page_id, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN "
    + HOST.format("target")
    + " ELSE own END AS host FROM t) SELECT host, count(*) AS links, count(DISTINCT page_id) AS pages FROM h GROUP BY host"
)
def html_links_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links_by_domain(pages(spark, sf_dir))


UNWRAP = r'<a\s[^>]*href="[^"]*(?:/the|/and)[^"]*"[^>]*>(.*?)</a>'


@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, {quoted('(?is)' + UNWRAP)})) AS BIGINT) AS unwrapped, CAST(length(regexp_replace(html, {quoted('(?is)' + UNWRAP)}, '\\1', 'g')) AS BIGINT) AS clean_chars FROM pages")
def html_link_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.unwrap_links(pages(spark, sf_dir), ("/the", "/and"))


# Diagnosis and reports

PROFILE = r"""SELECT doc_id, pos, bool_or(hidden) AS has_hidden, bool_or(italic) AS has_italic, coalesce(list_sort(list(DISTINCT color) FILTER (color IS NOT NULL)), []) AS colors,
    coalesce(list_sort(list(DISTINCT rstyle) FILTER (rstyle IS NOT NULL)), []) AS char_styles, arg_min(substr(txt, 1, 30), run) AS first_run FROM spec_runs"""
SHOWN = f"SELECT l.doc_id, l.pos, {PREVIEW.replace('txt', 'l.txt')} AS preview, pstyle, coalesce(has_hidden, FALSE) AS has_hidden, coalesce(has_italic, FALSE) AS has_italic, coalesce(array_to_string(colors, ','), '') AS colors, coalesce(array_to_string(char_styles, ','), '') AS char_styles, first_run FROM spec_lines l LEFT JOIN profile p ON l.doc_id = p.doc_id AND l.pos = p.pos WHERE {SOLID.format('l.txt')}"
TEXT_RUNS = (f"profile AS ({PROFILE} WHERE {SOLID.format('txt')} GROUP BY doc_id, pos)",)
ANY_RUNS = (f"profile AS ({PROFILE} GROUP BY doc_id, pos)",)
FINDINGS = (
    *ANY_RUNS,
    f"hits AS (SELECT *, list_filter({list(R.KEYWORDS)}, lambda k: contains(lower(txt), k)) AS keywords FROM spec_lines WHERE {SOLID.format('txt')})",
    "findings AS (SELECT h.*, has_hidden, has_italic, colors, char_styles FROM hits h LEFT JOIN profile p ON h.doc_id = p.doc_id AND h.pos = p.pos WHERE len(keywords) > 0)",
)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "spec_lines"), view(spark, sf_dir, "spec_runs")


@query(oracle(("spec_runs",), SHOWN + " AND contains(lower(l.txt), 'coordinate')", TEXT_RUNS))
def diagnose_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.interesting(*both(spark, sf_dir), search="Coordinate")


@query(oracle(("spec_runs",), SHOWN + " AND contains(lower(l.txt), 'coordinate')", TEXT_RUNS))
def diagnose_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stored index: only segments that hold the rarest pieces of the text are read."""
    lines, runs = both(spark, sf_dir)
    index = textindex.build(lines, "txt", new_folder(spark), segment=64)
    return diagnose.interesting(textindex.search(spark, index, "Coordinate"), runs, show_all=True)


@query(oracle(("spec_runs",), SHOWN + " AND (has_hidden OR len(colors) > 0 OR len(char_styles) > 0)", TEXT_RUNS))
def diagnose_interesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.interesting(*both(spark, sf_dir))


@query(oracle(("spec_runs",), SHOWN, TEXT_RUNS))
def diagnose_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.interesting(*both(spark, sf_dir), show_all=True)


@query(oracle(("spec_runs",), "SELECT doc_id, pos, array_to_string(keywords, ',') AS keywords, pstyle, has_hidden, has_italic, array_to_string(colors, ',') AS colors, array_to_string(char_styles, ',') AS char_styles FROM findings", FINDINGS))
def diagnose_editorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnose.editorial(*both(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("keywords", "colors", "char_styles")]
    return found.select("doc_id", "pos", joined[0], "pstyle", "has_hidden", "has_italic", *joined[1:])


@query(
    oracle(
        ("spec_runs",),
        "SELECT count(*) AS findings, count(*) FILTER (has_hidden) AS hidden_count, count(*) FILTER (has_italic) AS italic_count, array_to_string(list_sort(list_distinct(flatten(list(colors)))), ',') AS all_colors, array_to_string(list_sort(list_distinct(flatten(list(char_styles)))), ',') AS all_char_styles, array_to_string(list_sort(list(DISTINCT pstyle) FILTER (pstyle IS NOT NULL)), ',') AS all_para_styles FROM findings",
        FINDINGS,
    )
)
def diagnose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.editorial_summary(diagnose.editorial(*both(spark, sf_dir)))


@query(oracle(("spec_lines",), f"SELECT doc_id, pos, content_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ord) AS nth, {PREVIEW} AS preview FROM found", PARAGRAPHS))
def report_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(paragraphs_found(spark, sf_dir)).select("doc_id", "pos", "content_type", "nth", "preview")
