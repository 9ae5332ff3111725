from pyspark.sql import functions as F

from winnower import rules
from winnower.functions import text
from winnower.operators import deep, detect, html, styles

STYLE = "pkg_id int, style_id string, based_on string, linked string, next_style string, is_default boolean"


def test_cyclic_closure_ends_and_counts_undefined(spark):
    defined = spark.createDataFrame([(1, "A", None, "B", "A", False), (1, "B", None, "A", None, False), (1, "C", "Ghost", None, None, True), (2, "A", None, None, None, False)], STYLE)
    used = spark.createDataFrame([(1, "A"), (1, "C"), (1, "Lost")], "pkg_id int, style_id string")
    got = {(r["pkg_id"], r["style_id"]) for r in styles.closure(defined, used).collect()}
    assert got == {(1, "A"), (1, "B"), (1, "C"), (1, "Ghost"), (1, "Lost")}
    status = {(r["pkg_id"], r["style_id"]): r["status"] for r in styles.style_status(defined, styles.closure(defined, used)).collect()}
    assert status == {(1, "A"): "used", (1, "B"): "used", (1, "C"): "used", (2, "A"): "unused"}


def test_closure_of_a_long_chain(spark):
    chain = [(1, f"S{i}", f"S{i + 1}", None, None, False) for i in range(130)]
    reached = styles.closure(spark.createDataFrame(chain, STYLE), spark.createDataFrame([(1, "S0")], "pkg_id int, style_id string"))
    assert reached.count() == 131


def test_default_is_protected_in_one_clean_and_orphaned_in_the_other(spark):
    defined = spark.createDataFrame([(1, "D", None, None, None, True), (1, "Normal", None, None, None, False)], STYLE)
    none = spark.createDataFrame([], "pkg_id int, style_id string")
    assert {r["status"] for r in styles.style_status(defined, styles.closure(defined, none)).collect()} == {"protected"}
    assert [r["style_id"] for r in styles.orphaned_styles(defined, none).collect()] == ["D"]


def test_media_by_suffix(spark):
    media = spark.createDataFrame([(1, "word/media/image1.png", 1), (1, "word/media/myimage1.png", 1), (1, "word/media/x.png", 1), (2, "word/media/image1.png", 1)], "pkg_id int, part string, size_bytes long")
    rels = spark.createDataFrame([(1, "media/image1.png"), (2, "styles.xml")], "pkg_id int, target string")
    assert sorted((r["pkg_id"], r["part"]) for r in deep.orphaned_media(media, rels).collect()) == [(1, "word/media/x.png"), (2, "word/media/image1.png")]


def test_rsid_spacing(spark):
    df = spark.createDataFrame([('<w:p w:rsidR = "x" W:RSIDP="y">',)], "xml string")
    row = deep.rsid_counts(df).first()
    assert (row["scanned"], row["stripped"], row["clean"]) == (2, 1, '<w:p w:rsidR = "x">')


def test_owning_part(spark):
    got = spark.createDataFrame([("word/_rels/document.xml.rels",), ("_rels/.rels",)], "p string").select(deep.owning_part(F.col("p"))).collect()
    assert [r[0] for r in got] == ["word/document.xml", None]


PARAGRAPH = "id int, txt string, pstyle string"
RUN = "id int, txt string, italic boolean, bold boolean, hidden boolean, color string, rstyle string, parent_is_p boolean"


def test_decisions(spark):
    paragraphs = spark.createDataFrame([(1, "seen gone", None), (2, "gone", None), (3, "[TBD]", None), (4, "END OF SECTION [TBD]", None), (5, "x END OF SECTION", None), (6, "", None)], PARAGRAPH)
    h = lambda i, t, hidden=True: (i, t, False, False, hidden, None, None, True)
    runs = spark.createDataFrame([h(1, "seen", False), h(1, "gone"), h(2, "gone"), h(2, "  ", False), h(3, "[TBD]"), h(4, "x"), h(5, "x "), h(5, "END OF SECTION")], RUN)
    got = {r["id"]: (r["decision"], r["removed"], r["run_detections"]) for r in detect.decide(paragraphs, runs, ["id"]).collect()}
    assert got == {1: ("kept", False, 1), 2: ("all runs", True, 1), 3: ("paragraph", True, 0), 4: ("whitelisted", False, 0), 5: ("run whitelisted", False, 2), 6: ("kept", False, 0)}


def test_unwrap_keeps_what_links_enclose(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", 'go <a href="http://b.example/q?x=.">here</a> or <a href="/c">there</a>')], "page_id int, url string, html string")
    assert html.unwrap_links(pages, ["b.example"]).first()["unwrapped"] == 1
    assert sorted((r["host"], r["links"]) for r in html.links_by_domain(pages).collect()) == [("a.example", 1), ("b.example", 1)]


def test_each_pattern_is_tried_once(spark):
    from winnower.operators import report

    lines = spark.createDataFrame([(1, 1, "[TBD] all rights reserved", "CMT")], "doc_id int, pos int, txt string, pstyle string")
    found = detect.exploded(detect.with_detections(lines, detect.paragraph_element()))
    patterns = sum(len(s.patterns) for s in rules.DEFAULT.sections.values())
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    for query in (found, report.counts_by_type(found), found.where("confidence > 0.5")):
        plan = query._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") <= patterns + 3


def test_cheap_test_promises_no_more_than_the_pattern(spark):
    texts = ["K\u0131 edit", "Ed\u0131t as required", "SELECT \u017fE one", "\u212a", "[TBD]", "[ ]", "EDIT AS REQUIRED", "Gänse © 2024", ". 12", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "txt string").withColumn("low", text.lowered(F.col("txt")))
    for section in rules.DEFAULT.sections.values():
        for p in section.patterns:
            got = df.select(text.matches(F.col("txt"), p), text.matches(F.col("txt"), p, F.col("low"))).collect()
            assert all(a == b for a, b in got), p
    assert [text.literal(p) for p in (r"a|b", r"x?yz", r"(ab)c\d+de", r"[^]a]q", r"\x41b", r"ab{0}c", "Ä b")] == ["", "yz", "de", "q", "", "a", ""]


def test_closure_of_five_thousand_styles_in_few_jobs(spark):
    chain = [(1, f"S{i}", f"S{i + 1}", None, f"S{i}" if i % 7 else "S0") for i in range(5000)] + [(2, "S1", None, None, None)]
    spark.sparkContext.setJobGroup("closure", "closure")
    reached = styles.closure(spark.createDataFrame(chain, "pkg_id int, style_id string, based_on string, linked string, next_style string"), spark.createDataFrame([(1, "S0")], "pkg_id int, style_id string"))
    got = {tuple(r) for r in reached.collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("closure")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(1, f"S{i}") for i in range(5001)} and len(jobs) <= 16


def inside(nodes):
    """Pairs by walking up from each element."""
    parent = {(p, n): up for p, n, up, *_ in nodes}
    out = set()
    for p, n, up, *_ in nodes:
        while up is not None:
            out.add((p, up, n))
            up = parent[p, up]
    return out


def test_containment_equals_a_walk(spark):
    import random

    from winnower.operators import containment

    rng, rows = random.Random(3), []
    for part, shape in (("a", "wide"), ("b", "deep"), ("c", "mixed"), ("d", "single")):
        stack, size = [], 1 if shape == "single" else 400
        for n in range(size):
            drop = {"wide": 0.9, "deep": 0.02, "mixed": 0.5, "single": 0}[shape]
            while len(stack) > 1 and rng.random() < drop:
                stack.pop()
            rows.append([part, n, stack[-1] if stack else None, rng.choice("xyz")])
            stack.append(n)
    last, parent = {}, {(p, n): up for p, n, up, _ in rows}
    for p, n, _, _ in reversed(rows):
        up = n
        while up is not None:
            last.setdefault((p, up), n)
            up = parent[p, up]
    df = spark.createDataFrame([("k", p, n, last[p, n], t) for p, n, _, t in rows], "pkg_id string, part string, node_id int, last_desc_id int, tag string")
    tags = {(p, n): t for p, n, _, t in rows}
    found = containment.contained(df.where("tag in ('x', 'y')"), df.where("tag <> 'y'"))
    want = {(p, a, d) for p, a, d in inside(rows) if tags[p, a] in "xy" and tags[p, d] != "y"}
    got = [(r["part"], r["ancestor"], r["descendant"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    above = {}
    for p, a, d in want:
        above.setdefault((p, d), []).append(a)
    inner = {(r["part"], r["descendant"]): (r["ancestor"], r["depth"]) for r in containment.nearest(found).collect()}
    assert inner == {k: (max(x), len(x)) for k, x in above.items()}


def test_containment_of_a_million_elements(spark):
    """A part of a million elements: 50,000 spans of 20; candidates stay near the answers."""
    from winnower.operators import containment

    spans = spark.range(50_000).selectExpr("'k' AS pkg_id", "'p' AS part", "cast(id * 20 AS int) AS node_id", "cast(id * 20 + 19 AS int) AS last_desc_id")
    texts = spark.range(1_000_000).selectExpr("'k' AS pkg_id", "'p' AS part", "cast(id AS int) AS node_id")
    assert containment.contained(spans, texts).count() == 950_000
    assert containment.blocks(spans).count() <= 3 * 50_000


def test_rules_of_a_table_find_what_each_pattern_finds(spark):
    import re

    from winnower import rules as R
    from winnower.operators import ruletable

    patterns = [(s, i, p) for s, part in R.DEFAULT.sections.items() for i, p in enumerate(part.patterns)]
    patterns += [("own", 0, "abc"), ("own", 1, "a|b{2}"), ("own", 2, r"straße"), ("own", 3, r"kilo\s+meter"), ("own", 4, r"kilo\s+meter"), ("own", 5, "x" * 50)]
    texts = ["NOTE TO SPECIFIER: x", "Copyright 2024 all rights reserved", "[TBD] retain or delete", "   ", "", None, "Kilo  meter", "STRAßE", "ABC", "bb", "x" * 60, "ſpecagent", "End of Section"]
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, txt string")
    found = ruletable.hits(lines, spark.createDataFrame(patterns, "section string, seq int, pattern string"), ("k",))
    got = {(r["k"], r["section"], r["seq"]) for r in found.collect()}
    want = {(k, s, i) for k, t in enumerate(texts) if t is not None for s, i, p in patterns if re.search(p, t, re.I | re.S)}
    assert got == want and found.count() == len(want)
    first = {(r["k"], r["section"]): (r["seq"], r["n_hits"]) for r in ruletable.first_hits(found, ("k",)).collect()}
    assert first == {(k, s): (min(i for a, b, i in want if (a, b) == (k, s)), sum((a, b) == (k, s) for a, b, _ in want)) for k, s, _ in want}


def test_bookmarks_of_another_package_stay(spark):
    rows = [("a", "word/document.xml", 1, "bookmarkStart", "_GoBack", "0"), ("b", "word/document.xml", 2, "bookmarkStart", "Chapter", "0"), ("b", "word/document.xml", 3, "bookmarkEnd", None, "0"), ("a", "word/header1.xml", 4, "bookmarkEnd", None, "0"), ("a", "word/document.xml", 5, "bookmarkEnd", None, "0")]
    from winnower.operators import deep

    found = deep.bookmark_pairs(spark.createDataFrame(rows, "pkg_id string, part string, node_id int, tag string, name string, bm_id string"))
    assert sorted(r["node_id"] for r in found.collect()) == [1, 5]


def test_search_by_index_reads_few_segments(spark, tmp_path):
    from winnower.operators import textindex

    rows = [(i, f"line {i} of common words" + (" with a Needle in it" if i in (7, 900) else "") + (" need le" if i % 50 == 0 else "")) for i in range(2000)] + [(-1, None), (-2, "")]
    lines = spark.createDataFrame(rows, "k int, txt string").repartition(3)
    index = textindex.build(lines, "txt", f"file://{tmp_path}/index", segment=20, buckets=64)
    assert index.lines(spark).count() == len(rows)
    for text in ("needle", "NEEDLE IN", "common", "zz top", "li", "", "line 77 "):
        want = {k for k, t in rows if t is not None and text.lower() in t.lower()}
        assert {r["k"] for r in textindex.search(spark, index, text).collect()} == want
    wanted = ["nee", "eed", "edl", "dle"]
    assert 1 <= textindex.segments_with(spark, index, wanted).count() <= 2
    plan = textindex.search(spark, index, "needle")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_targets_of_relationships(spark):
    from winnower.operators import reachability

    cases = [("_rels/.rels", "word/document.xml", "word/document.xml"), ("word/_rels/document.xml.rels", "styles.xml", "word/styles.xml"), ("word/_rels/document.xml.rels", "/docProps/app.xml", "docProps/app.xml"), ("word/_rels/document.xml.rels", "../customXml/./item1.xml", "customXml/item1.xml"), ("a/b/_rels/c.rels", "../../../d", "d")]
    df = spark.createDataFrame(cases, "f string, t string, want string")
    assert [r[0] for r in df.select(reachability.target_part(F.col("f"), F.col("t"))).collect()] == [c[2] for c in cases]


def test_rules_with_one_pattern_are_tried_once(spark):
    from winnower.operators import ruletable

    words = [f"{a}{b}word" for a in "abcdefghijkl" for b in "mnopqrstuvwxyz"]
    assert len(words) > ruletable.FEW
    patterns = [("phrases", i, "kilo meter away") for i in range(500)] + [("words", i, w) for i, w in enumerate(words)] + [("words", 900, "to me"), ("other", 3, "kilo meter away")]
    rules = spark.createDataFrame(patterns, "section string, seq int, pattern string")
    texts = ["a Kilo meter away", "kilo meter aways amword", "LZWORD came to me", "nothing", None, ""]
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, txt string")
    want = {(k, s, i) for k, t in enumerate(texts) if t for s, i, p in patterns if p in t.lower()}
    assert {(r["k"], r["section"], r["seq"]) for r in ruletable.hits(lines, rules, ("k",)).collect()} == want
    assert ruletable.pattern_hits(lines, rules, ("k",)).count() == 5
    assert {(r["section"], r["seq"]): r["lines"] for r in ruletable.line_counts(lines, rules, ("k",)).collect()} == {(s, i): sum((s, i) == (a, b) for _, a, b in want) for _, s, i in want}
    assert [tuple(r) for r in ruletable.first_hits(ruletable.class_hits(lines, rules, ("k",)), ("k",)).where("k = 0").orderBy("section").collect()] == [(0, "other", 3, "kilo meter away", 1), (0, "phrases", 0, "kilo meter away", 500)]
