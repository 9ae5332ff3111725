import re

import pytest
from pyspark.sql import functions as F

from winnower import rules as R
from winnower.functions.text import all_hits, first_hit, matches, nonblank, preview
from winnower.operators import detect

# one string that each pattern must find and one that it must not, in the order of the lists
TRUTH = {
    "specifier_notes": [
        ("[Specifier: check]", "specifier check"), ("[NOTE TO SPECIFIER]", "note to [specifier]"), ("Note to specifier: x", "note to specifiers"), ("[specifier note]", "specifier note"),
        ("[Editor's Note: a]", "edit a note"), ("[Coordinator note]", "coordinator note"), ("<Specifier x>", "specifier x>"), ("*** a ***", "b *** a ***"), ("[Verify model]", "[verify]"),
        ("[Coordinate with x]", "[coordinate]"), ("[confirm size]", "confirm size"),
    ],
    "copyright_notices": [
        ("© 2020", "(c) 2020"), ("Copyright 2024", "copyright 24"), ("copyright ©", "copyright c"), ("All rights  reserved", "all rights"), ("may not be reproduced", "may be reproduced"),
        ("proprietary\tinformation", "proprietary info"), ("Licensed for use by", "licensed for use"), ("duplication is prohibited", "prohibited duplication"), ("unauthorized\nreproduction", "unauthorized copy"),
    ],
    "specagent_references": [("specagent.com", "specagent com"), ("SpecAgent", "spec"), ("spec agent", "spec-agent"), ("www.specagent", "www specagent"), ("produced by specagent", "produced by agent"), ("generated  by specagent", "generated specagent")],
    "editorial_artifacts": [
        ("retain or delete", "retain delete"), ("delete if not used", "delete if used"), ("retain if required", "retain required"), ("Select one", "selectone"), ("choose\none", "choose two"), ("delete options not selected", "delete options"),
        ("revise as required", "revise"), ("edit as required", "edit required"), ("modify as required", "modify"), ("coordinate with owner", "coordinate with us"), ("<insert name>", "insert name"), ("[insert]", "(insert)"),
        ("{insert x}", "[x insert}"), ("<enter x>", "enter x"), ("[enter]", "enter"), ("[ ]", "[x]"), ("< >", "<x>"), ("[__]", "[_x]"), ("<_>", "<x>"), ("[...]", "[.]"), ("delete this line", "delete line"),
        ("remove this section", "remove section"), ("to be determined", "be determined"), ("[TBD]", "tbd"), ("[n/a]", "n/a"), ("[pending]", "pending"), ("fill in the blank", "fill the blank"), ("complete this section", "complete section"),
        ("verify before ", "verify it"), ("--- optional ---", "-- optional --"), ("=== optional ===", "= optional ="), ("***optional***", "**optional**"), (" .1 ", "a .1"), ("optional paragraph", "optional"), ("alternate paragraph", "alternate"),
    ],
    "preserve_patterns": [("END OF SECTION", "the end of section"), ("Section 238126", "section 12"), ("PART 1 - GENERAL", "part 1 general"), ("Article 2: x", "an article 2:")],
}


def test_truth_table(spark):
    rows = [(s, i, yes, no) for s, cases in TRUTH.items() for i, (yes, no) in enumerate(cases)]
    assert len(rows) == 65
    for section, i, yes, no in rows:
        pattern = R.DEFAULT.section(section).patterns[i]
        assert re.search(pattern, yes, re.I | re.S), pattern
        assert not re.search(pattern, no, re.I | re.S), pattern
    tests = [F.struct(matches(F.lit(y), R.DEFAULT.section(s).patterns[i]).alias("y"), matches(F.lit(n), R.DEFAULT.section(s).patterns[i]).alias("n")) for s, i, y, n in rows]
    for part in range(0, 65, 13):
        got = spark.range(1).select(F.array(*tests[part : part + 13])).first()[0]
        assert all(x["y"] and not x["n"] for x in got)


def test_missing_section_is_enabled_and_empty():
    rules = R.from_config({"hidden_text": {"enabled": False}, "style_based_detection": {"paragraph_styles": ["A"], "character_styles": ["B"]}})
    assert rules.section("copyright_notices") == R.Section()
    assert not rules.section("hidden_text").enabled
    assert rules.styles == ("A", "B")


def test_load(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({"copyright_notices": {"text_patterns": ["©"]}}), encoding="utf-8")
    assert R.load(tmp_path / "r.yaml").section("copyright_notices").patterns == ("©",)


def test_text_functions(spark):
    row = spark.createDataFrame([("select one, [tbd] © copyright 2020",)], "t string").select(
        first_hit(F.col("t"), R.EDITORIAL_PATTERNS).alias("f"), all_hits(F.col("t"), R.COPYRIGHT_PATTERNS).alias("a"), first_hit(F.col("t"), ()).alias("none"), nonblank(F.lit(" \t")).alias("blank"), preview(F.lit("a\nb\r" + "c" * 90)).alias("p")
    ).first()
    assert row["f"] == r"select\s+one"
    assert row["a"] == ["©", r"copyright\s+\d{4}"]
    assert row["none"] is None and row["blank"] is False
    assert row["p"] == "a↵b" + "c" * 76 + "..."


RUN = "id int, txt string, italic boolean, bold boolean, hidden boolean, color string, rstyle string, parent_is_p boolean"


def found(df, element):
    return {r["id"]: [(d["content_type"], d["confidence"]) for d in r["found"]] for r in detect.with_detections(df, element).collect()}


def test_run_scores(spark):
    runs = [
        (1, "plain", True, False, False, "ff0000", None, True), (2, "plain", True, False, False, None, None, True), (3, "plain", False, False, False, "0070C0", None, True), (4, "plain", False, False, False, None, "CMT", True),
        (5, "[Verify it]", False, False, False, "FF0000", None, True), (6, "  ", False, False, True, None, None, False), (7, "END OF SECTION [TBD]", False, False, True, None, None, True), (8, None, False, False, None, None, None, True),
    ]
    got = found(spark.createDataFrame(runs, RUN), detect.run_element())
    assert got[1] == [("specifier_note", 0.5)] and got[2] == [] and got[3] == []
    assert got[4] == [("specifier_note", 0.8)]
    assert got[5] == [("specifier_note", 0.6 + 0.3)]
    assert got[6] == [("hidden_text", 1.0)]
    assert got[7] == [("preserve", 1.0)]
    assert got[8] == []


def test_paragraph_scores_and_custom_detector(spark):
    df = spark.createDataFrame([(1, "x", "CMT"), (2, "x", "cmt"), (3, "© copyright 2020", None), (4, "© only", None)], "id int, txt string, pstyle string")
    got = found(df, detect.paragraph_element())
    assert got == {1: [("specifier_note", 0.8)], 2: [], 3: [("copyright", 1.0)], 4: [("copyright", 0.7)]}
    short = ("short", lambda e: (F.when(F.length(e.text) == 1, F.lit(0.9)), F.lit("one character")))
    more = df.select("id", detect.detections(detect.paragraph_element(), custom=[short]).alias("found")).where("id = 2").first()
    assert [(d["content_type"], d["reason"]) for d in more["found"]] == [("short", "one character")]


def test_empty_rules_find_nothing(spark):
    df = spark.createDataFrame([("[TBD] ©", "CMT")], "txt string, pstyle string")
    assert detect.with_detections(df, detect.paragraph_element(), R.Rules()).first()["found"] == []
