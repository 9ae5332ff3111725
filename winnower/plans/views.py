"""Derived fixture views over the driver's tables: integer arithmetic on ids injects markers, so that every engine computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A line's text and style, a third of a text, and what a run has, of a line l and a run r.
TEXT = """CASE (doc_id * 31 + pos) % 23
    WHEN 0 THEN concat('[Specifier: verify model] ', line)
    WHEN 1 THEN concat('NOTE TO SPECIFIER: ', line)
    WHEN 2 THEN concat(line, ' Copyright 2024 Example Co. All rights reserved.')
    WHEN 3 THEN concat('RETAIN OR DELETE ', line)
    WHEN 4 THEN 'PART 1 - GENERAL [TBD]'
    WHEN 5 THEN 'Generated by SpecAgent'
    WHEN 6 THEN concat(line, ' [___]')
    WHEN 7 THEN '   '
    WHEN 8 THEN 'END OF SECTION <insert name>'
    WHEN 9 THEN concat('Coordinate with architect. ', line)
    WHEN 10 THEN concat('*** ', concat(line, ' ***'))
    ELSE line END"""
STYLE = "CASE (doc_id * 17 + pos) % 29 WHEN 0 THEN 'CMT' WHEN 1 THEN 'cmt' WHEN 2 THEN 'BodyText' END"
THIRD = "CAST(floor(length(txt) / 3) AS INT)"
RUN = {
    "txt": "CASE r.run WHEN 0 THEN substr(l.txt, 1, l.k) WHEN 1 THEN substr(l.txt, l.k + 1, l.k) ELSE substr(l.txt, 2 * l.k + 1) END",
    "italic": "(l.doc_id + l.pos * 3 + r.run) % 4 = 0",
    "bold": "(l.doc_id + l.pos + r.run) % 5 = 0",
    "hidden": "(l.doc_id * 3 + l.pos) % 13 = 0 OR (l.doc_id + l.pos * 7 + r.run) % 11 = 0",
    "color": "CASE (l.doc_id * 5 + l.pos + r.run) % 8 WHEN 0 THEN 'FF0000' WHEN 1 THEN '0070c0' WHEN 2 THEN '00FF00' END",
    "rstyle": "CASE (l.doc_id + l.pos * 2 + r.run) % 37 WHEN 0 THEN 'EditorNote' WHEN 1 THEN 'Strong' END",
    "parent_is_p": "NOT (r.run = 2 AND (l.doc_id + l.pos) % 9 = 0)",
}

#: Each view's SQL; where engines differ, under the engine's name. A view may use tables and the views before it.
VIEWS: dict[str, dict[str, str]] = {
    "lines": {
        "spark": """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, posexplode(split(text, chr(10))) AS (pos, line) FROM documents)
""",
        "duckdb": """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
""",
    },
    "spec_lines": {
        "both": f"""
SELECT doc_id, pos, {TEXT} AS txt,
  {STYLE} AS pstyle
FROM lines
""",
    },
    "spec_runs": {
        "both": f"""
SELECT l.doc_id, l.pos, r.run,
  {",\n  ".join(f"{e} AS {n}" for n, e in RUN.items())}
FROM (SELECT doc_id, pos, txt, {THIRD} AS k FROM spec_lines) l
CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 UNION ALL SELECT 2) r
""",
    },
    "style_names": {
        "both": """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS pkg_id, doc_id % 50 AS o,
  CASE doc_id % 50 WHEN 3 THEN 'Heading1' WHEN 5 THEN 'Normal' WHEN 7 THEN 'ListParagraph' ELSE concat('S', CAST(doc_id % 50 AS STRING)) END AS style_id
FROM documents
""",
    },
    "spec_styles": {
        "both": """
SELECT s.pkg_id, s.style_id,
  CASE WHEN s.o % 23 = 9 THEN 'Missing' ELSE b.style_id END AS based_on,
  k.style_id AS linked,
  CASE WHEN s.o % 4 = 0 THEN s.style_id END AS next_style,
  CASE s.o % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'character' WHEN 2 THEN 'table' ELSE 'numbering' END AS style_type,
  s.o % 25 = 6 AS is_default
FROM style_names s
LEFT JOIN style_names b ON b.pkg_id = s.pkg_id AND b.o = CASE WHEN s.o > 0 THEN CAST(floor(s.o / 3) AS BIGINT) END
LEFT JOIN style_names k ON k.pkg_id = s.pkg_id AND k.o = s.o + CASE s.o % 10 WHEN 0 THEN 1 WHEN 1 THEN -1 END
""",
    },
    "spec_style_refs": {
        "both": """
SELECT pkg_id, style_id FROM style_names WHERE (o * 7 + pkg_id) % 11 = 0 AND o > 3
UNION ALL SELECT DISTINCT pkg_id, 'Ghost' AS style_id FROM style_names WHERE pkg_id % 5 = 0
""",
    },
    "spec_media": {
        "both": """
SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS pkg_id, concat('word/media/', concat(CASE WHEN p_partkey % 7 = 0 THEN 'myimage' ELSE 'image' END, concat(CAST(p_partkey % 100 AS STRING), '.png'))) AS part,
  CAST(p_size * 1000 AS BIGINT) AS size_bytes
FROM part
""",
    },
    "spec_rels": {
        "both": """
SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS pkg_id,
  CASE p_partkey % 5 WHEN 0 THEN '_rels/.rels' WHEN 1 THEN 'word/_rels/header1.xml.rels' ELSE 'word/_rels/document.xml.rels' END AS source_file,
  concat('rId', CAST(p_partkey AS STRING)) AS rid,
  CASE WHEN p_partkey % 3 = 0 THEN concat(CASE WHEN p_partkey % 100 < 60 THEN 'media/image' ELSE 'embeddings/image' END, concat(CAST(p_partkey % 100 AS STRING), '.png'))
       WHEN p_partkey % 3 = 1 THEN concat(CASE WHEN p_partkey % 4 = 0 THEN 'https://WWW.Vendor.example.com/p/' ELSE 'https://other.example.org/' END, CAST(p_partkey AS STRING))
       ELSE 'styles.xml' END AS target,
  CASE WHEN p_partkey % 3 = 0 THEN '/relationships/image' WHEN p_partkey % 3 = 1 THEN '/relationships/hyperlink' ELSE '/relationships/styles' END AS type,
  CASE WHEN p_partkey % 3 = 1 THEN 'External' END AS target_mode
FROM part
""",
    },
    "spec_xml": {
        "both": """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS pkg_id, CASE doc_id % 3 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'word/settings.xml' ELSE 'word/header1.xml' END AS part, doc_id AS seq,
  concat('<w:p w:rsidR="00A1"', concat(CASE WHEN doc_id % 2 = 0 THEN ' w:rsidRPr = "00B2"' ELSE ' W:RSIDP="00C3"' END,
  concat('><w:r', concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' w:rsidRDefault="00D4"' END, '><w:t>x</w:t></w:r></w:p>')))) AS xml
FROM documents
""",
    },
    "spec_nodes": {
        "both": """
SELECT CAST(floor(event_id / 160) AS BIGINT) AS pkg_id, event_id AS node_id,
  CASE WHEN event_id % 16 IN (0, 1, 5, 6) THEN CASE CAST(floor(event_id / 16) AS BIGINT) % 6 WHEN 0 THEN 'word/header1.xml' WHEN 1 THEN 'word/styles.xml' WHEN 2 THEN 'word/footnotes.xml' WHEN 3 THEN 'word/comments.xml' ELSE 'word/document.xml' END
    WHEN event_id % 16 < 7 THEN 'word/document.xml' WHEN event_id % 16 < 13 THEN 'word/settings.xml'
    WHEN CAST(floor(event_id / 16) AS BIGINT) % 5 = 0 THEN 'word/fontTable.xml' ELSE 'word/theme/theme1.xml' END AS part,
  CASE event_id % 16 WHEN 0 THEN 'r' WHEN 1 THEN 'r' WHEN 2 THEN 'bookmarkStart' WHEN 3 THEN 'bookmarkEnd' WHEN 4 THEN 'proofErr' WHEN 5 THEN 'rPr' WHEN 6 THEN 'r'
    WHEN 7 THEN 'compatSetting' WHEN 8 THEN 'useFELayout' WHEN 9 THEN 'cachedColBalance' WHEN 10 THEN 'proofState' WHEN 11 THEN 'noProof' WHEN 12 THEN 'growAutofit' ELSE 'font' END AS tag,
  CASE WHEN event_id % 16 IN (7, 8, 9, 12) AND CAST(floor(event_id / 16) AS BIGINT) % 4 > 0 THEN 'compat' WHEN event_id % 16 < 7 THEN 'p' ELSE 'settings' END AS parent_tag,
  CASE event_id % 16 WHEN 0 THEN 't' WHEN 1 THEN 'footnoteReference' END AS child_tag,
  CASE WHEN event_id % 16 = 2 THEN concat(CASE user_id % 6 WHEN 0 THEN '_GoBack' WHEN 1 THEN '_Ref' WHEN 2 THEN '_Toc' WHEN 3 THEN '_Hlk' WHEN 4 THEN '_PictureBullets' ELSE 'Chapter' END, CASE WHEN user_id % 6 = 0 THEN '' ELSE CAST(user_id AS STRING) END)
       WHEN event_id % 16 = 7 THEN CASE WHEN user_id % 2 = 0 THEN 'overrideTableStyleFontSizeAndJustification' ELSE 'compatibilityMode' END END AS name,
  CASE WHEN event_id % 16 IN (2, 3) THEN CAST(floor(event_id / 16) AS BIGINT) % 7 END AS bm_id,
  CASE WHEN event_id % 16 >= 13 THEN CASE user_id % 5 WHEN 0 THEN 'Jpan' WHEN 1 THEN 'Latin' WHEN 2 THEN '' WHEN 3 THEN 'Arab' ELSE 'ea' END END AS script,
  CASE WHEN event_id % 16 >= 13 THEN concat('Face ', CAST(user_id % 7 AS STRING)) END AS typeface
FROM events
""",
    },
    # A document's lines as elements: the parent of line n is n without its lowest bit, so ids are in document order.
    "spec_tree": {
        "both": """
SELECT l.doc_id AS pkg_id, CASE l.doc_id % 3 WHEN 0 THEN 'word/header1.xml' ELSE 'word/document.xml' END AS part, pos AS node_id, CASE WHEN pos > 0 THEN pos & (pos - 1) END AS parent_id,
  CASE WHEN pos = 0 THEN n - 1 ELSE least(n, pos + (pos & -pos)) - 1 END AS last_desc_id,
  CASE (pos * 7 + l.doc_id) % 5 WHEN 0 THEN 'tbl' WHEN 1 THEN 'tc' WHEN 2 THEN 'txbxContent' WHEN 3 THEN 'p' ELSE 't' END AS tag
FROM lines l JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) s ON l.doc_id = s.doc_id
""",
    },
    # A rule for each document that has two neighbouring words of four to eight letters: its first such pair.
    "spec_rules": {
        "spark": "SELECT doc_id AS seq, lower(pair) AS pattern FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]{4,8} [A-Za-z]{4,8}', 0) AS pair FROM documents) WHERE pair <> ''",
        "duckdb": "SELECT doc_id AS seq, lower(pair) AS pattern FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]{4,8} [A-Za-z]{4,8}', 0) AS pair FROM documents) WHERE pair <> ''",
    },
}

#: What each view is built on.
NEEDS = {
    "lines": (), "spec_lines": ("lines",), "spec_runs": ("lines", "spec_lines"), "style_names": (), "spec_styles": ("style_names",),
    "spec_style_refs": ("style_names",), "spec_media": (), "spec_rels": (), "spec_xml": (), "spec_nodes": (), "spec_tree": ("lines",), "spec_rules": (),
}
TABLES = {"lines": ("documents",), "style_names": ("documents",), "spec_media": ("part",), "spec_rels": ("part",), "spec_xml": ("documents",), "spec_nodes": ("events",), "spec_rules": ("documents",)}


def with_clauses(names: tuple[str, ...], engine: str) -> list[str]:
    """Common table expressions for views and all they need, in order."""
    needed = [v for v in VIEWS if v in names or any(v in NEEDS[n] for n in names)]
    return [f"{v} AS ({(VIEWS[v].get(engine) or VIEWS[v]['both']).strip()})" for v in needed]


def source(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A table as a common table expression. Rows of few files are spread over all cores; a large table keeps its splits."""
    path = f"{sf_dir}/{table}.parquet"
    cores = spark.sparkContext.defaultParallelism
    hint = f"/*+ REPARTITION({cores}) */ " if table == "documents" and spark.read.parquet(path).rdd.getNumPartitions() < cores else ""
    return f"{table} AS (SELECT {hint}* FROM parquet.`{path}`)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t for v in (name, *NEEDS[name]) for t in TABLES.get(v, ())}
    sources = [source(spark, sf_dir, t) for t in sorted(tables)]
    return spark.sql(f"WITH {', '.join([*sources, *with_clauses((name,), 'spark')])} SELECT * FROM {name}")


def oracle(names: tuple[str, ...], body: str, more: tuple[str, ...] = (), recursive: bool = False) -> str:
    """SQL for the other engine over views; more: further common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*with_clauses(names, 'duckdb'), *more])} {body}"
