import io
import zipfile

import pytest
from pyspark.sql import functions as F

from winnower.plans import api
from winnower.sources import packages as P
from winnower.streaming.watch import clean_batch, watch

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
HIDDEN = "<w:rPr><w:vanish/></w:rPr>"


def run(text, props=""):
    return f'<w:r w:rsidR="00A1">{props}<w:t xml:space="preserve">{text}</w:t></w:r>'


def package(body, **more):
    parts = {
        "[Content_Types].xml": "<Types/>",
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>',
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
    } | {k.replace("__", "/"): v for k, v in more.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()


def frame(spark, **packages):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in packages.items()], "pkg_id string, content binary")


def main_part(cleaned, pkg, part="word/document.xml"):
    row = cleaned.parts.where((F.col("pkg_id") == pkg) & (F.col("part") == part)).select("data").first()
    return bytes(row["data"]).decode() if row else None


@pytest.fixture(scope="module")
def shallow(spark):
    cases = frame(
        spark,
        mixed=package(f"<w:p>{run('seen')}{run('secret é', HIDDEN)}</w:p>"),
        hidden=package(f"<w:p>{run('a', HIDDEN)}{run('b', HIDDEN)}</w:p><w:p>{run('stays')}</w:p>"),
        link=package(f"<w:p>{run('seen')}<w:hyperlink>{run('gone', HIDDEN)}</w:hyperlink></w:p>"),
        veto=package(f"<w:p>{run('END OF SECTION [TBD]')}</w:p>"),
        run_veto=package(f"<w:p>{run('x ', HIDDEN)}{run('END OF SECTION', HIDDEN)}</w:p>"),
        toggled=package("<w:p>" + run("red", '<w:rPr><w:i w:val="0"/><w:color w:val="ff0000"/></w:rPr>') + "</w:p>"),
        style=package(f'<w:p><w:pPr><w:pStyle w:val="CMT"/></w:pPr>{run("note")}</w:p><w:p>{run("stays")}</w:p>'),
        nested=package(f"<w:p>{run('outer ')}<w:r><w:txbxContent><w:p>{run('[TBD]')}</w:p></w:txbxContent></w:r></w:p>"),
        header=package(f"<w:p>{run('body')}</w:p>", word__header1_xml=None, **{"word/header1.xml": f"<w:hdr {W}><w:p>{run('© 2020')}</w:p></w:hdr>"}),
        clean=package(f"<w:p>{run('nothing to find > here')}</w:p>"),
    )
    return cases, api.shallow_clean(P.unpack(cases).cache())


def kinds(cleaned, pkg):
    rows = cleaned.detections.where(F.col("pkg_id") == pkg).select("level", "content_type", "confidence").collect()
    return sorted((r["level"], r["content_type"], r["confidence"]) for r in rows)


def test_mixed_paragraph_is_reported_not_removed(shallow):
    assert kinds(shallow[1], "mixed") == [("run", "hidden_text", 1.0)]
    assert "secret é" in main_part(shallow[1], "mixed")


def test_all_hidden_goes(shallow):
    text = main_part(shallow[1], "hidden")
    assert text.count("<w:p>") == 1 and "stays" in text


def test_loose_run_is_found_twice_and_removed(shallow):
    assert kinds(shallow[1], "link") == [("loose run", "hidden_text", 1.0), ("run", "hidden_text", 1.0)]
    assert "<w:hyperlink></w:hyperlink>" in main_part(shallow[1], "link") and "seen" in main_part(shallow[1], "link")


def test_whitelist(shallow):
    assert kinds(shallow[1], "veto") == [("paragraph", "preserve", 1.0)]
    assert "[TBD]" in main_part(shallow[1], "veto") and "END OF" in main_part(shallow[1], "run_veto")


def test_format_alone_and_styles(shallow):
    assert kinds(shallow[1], "toggled") == [("run", "specifier_note", 0.5)]
    assert "red" not in main_part(shallow[1], "toggled")
    assert "note" not in main_part(shallow[1], "style") and "stays" in main_part(shallow[1], "style")


def test_nested_paragraph_counts_for_the_outer_one(shallow):
    assert "outer" not in main_part(shallow[1], "nested")


def test_header_and_untouched_bytes(shallow):
    assert "©" not in main_part(shallow[1], "header", "word/header1.xml")
    before = {r["part"]: bytes(r["data"]) for r in P.unpack(shallow[0].where("pkg_id = 'clean'")).collect()}
    after = {r["part"]: bytes(r["data"]) for r in shallow[1].parts.where("pkg_id = 'clean'").collect()}
    assert before == after


def test_cleaning_twice_changes_nothing_more(shallow):
    again = api.shallow_clean(shallow[1].parts)
    assert again.cuts.count() == 0


def test_pack_round_trip(shallow):
    packed = P.pack(shallow[1].parts.where("pkg_id in ('clean', 'mixed')"))
    with zipfile.ZipFile(io.BytesIO(packed.where("pkg_id = 'clean'").first()["content"])) as z:
        assert z.namelist()[0] == "[Content_Types].xml" and z.testzip() is None


def test_bad_input(spark):
    cases = frame(spark, junk=b"no zip", bare=package("", **{"word/document.xml": None}), broken=package("<w:p>"), bomb=package("", **{"word/settings.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))
    parts = P.unpack(cases)
    assert {r["pkg_id"]: r["is_valid"] for r in P.validity(cases, parts).collect()} == {"junk": False, "bare": False, "broken": True, "bomb": True}
    nodes = P.shred(parts)
    errors = {(r["pkg_id"], r["part"]) for r in nodes.where("error is not null").collect()}
    assert errors == {("broken", "word/document.xml"), ("bomb", "word/settings.xml")}
    faults = {r["pkg_id"]: r["fault"] for r in api.validate(parts, nodes).collect()}
    assert faults["bare"] == "Missing word/document.xml" and faults["broken"] == "Invalid word/document.xml" and faults["bomb"] is None


@pytest.fixture(scope="module")
def deep_case(spark):
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    hyper = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
    styles = "".join(f'<w:style w:styleId="{i}"{d}><w:name w:val="{i}"/>{x}</w:style>' for i, d, x in (("A", "", '<w:link w:val="B"/><w:next w:val="A"/>'), ("B", "", '<w:link w:val="A"/>'), ("C", "", ""), ("D", ' w:default="1"', ""), ("Normal", "", "")))
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="A"/></w:pPr>{run("text")}<w:r w:rsidR="1"/><w:r><w:footnoteReference/></w:r><w:bookmarkStart w:id="1" w:name="_GoBack"/><w:bookmarkEnd w:id="1"/>'
        f'<w:bookmarkStart w:id="2" w:name="Chapter"/><w:bookmarkEnd w:id="2"/><w:proofErr/><w:hyperlink r:id="rId1">{run("linked")}</w:hyperlink></w:p>'
    )
    settings = f'<w:settings {W}><w:rsids><w:rsid w:val="1"/></w:rsids><w:compat><w:useFELayout/><w:other/></w:compat><w:noProof/><w:proofState/></w:settings>'
    links = f'<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{hyper}" Target="https://WWW.Vendor.example/x" TargetMode="External"/><Relationship Id="rId2" Type="image" Target="media/image1.png"/></Relationships>'
    theme = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:font script="Jpan"/><a:font script="Latin"/></a:theme>'
    data = package(body, **{"word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/settings.xml": settings, "word/_rels/document.xml.rels": links, "word/theme/theme1.xml": theme, "word/media/image1.png": "1", "word/media/myimage1.png": "22", "word/media/other.png": "333"})
    return P.unpack(frame(spark, d=data)).cache()


def test_deep_clean(deep_case):
    got = api.deep_clean(deep_case, domains=["vendor.example"])
    main = main_part(got, "d")
    assert "_GoBack" not in main and "Chapter" in main and main.count("bookmarkEnd") == 1
    assert "proofErr" not in main and "footnoteReference" not in main and "rsid" not in main
    assert "hyperlink" not in main and "linked" in main
    settings = main_part(got, "d", "word/settings.xml")
    assert "rsids" not in settings and "useFELayout" not in settings and "w:other" in settings and "noProof" in settings and "proofState" not in settings
    assert "rId1" not in main_part(got, "d", "word/_rels/document.xml.rels")
    theme = main_part(got, "d", "word/theme/theme1.xml")
    assert "Jpan" not in theme and "Latin" in theme
    assert {r["part"] for r in got.parts.where("part like 'word/media/%'").collect()} == {"word/media/image1.png", "word/media/myimage1.png"}
    styles = main_part(got, "d", "word/styles.xml")
    assert all(f'styleId="{i}"' in styles for i in ("A", "B", "Normal")) and all(f'styleId="{i}"' not in styles for i in "CD")


def test_deep_options(deep_case):
    only = api.deep_clean(deep_case, operations=["empty"], safe=True)
    assert "footnoteReference" in main_part(only, "d") and "_GoBack" in main_part(only, "d")
    block = api.deep_clean(deep_case, operations=["compat"], compat="aggressive")
    assert "compat" not in main_part(block, "d", "word/settings.xml")
    with pytest.raises(ValueError):
        api.deep_clean(deep_case, operations=["nothing"])


def test_style_clean_protects_defaults(deep_case):
    got = api.style_clean(deep_case)
    styles = main_part(got, "d", "word/styles.xml")
    assert 'styleId="D"' in styles and 'styleId="C"' not in styles


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package(f"<w:p>{run('[TBD]')}</w:p>"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1
    with zipfile.ZipFile(io.BytesIO(rows[0]["content"])) as z:
        assert b"TBD" not in z.read("word/document.xml")


def test_no_package_loses_members(spark, monkeypatch):
    monkeypatch.setattr(P, "LARGEST_MEMBER", 2000)
    note = f"<w:p>{run('[TBD]')}</w:p>"
    large, empty = "x" * 5000, io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    given = {
        "media": package(note, **{"word/media/image1.png": large, "word/media/image2.png": "1"}),
        "main": package(note + f"<w:p>{run(large)}</w:p>"),
        "header": package(note, **{"word/header1.xml": f"<w:hdr {W}><w:p>{run(large)}</w:p></w:hdr>"}),
        "junk": b"no zip",
        "empty": empty.getvalue(),
    }
    given["torn"] = given["media"].replace(b"[TBD]", b"[TBX]")  # the checksum of the main part fails
    packages = frame(spark, **given)
    got = {r["pkg_id"]: (bytes(r["content"]), r["error"]) for r in clean_batch(packages).collect()}
    assert set(got) == set(given)
    with zipfile.ZipFile(io.BytesIO(got["media"][0])) as new, zipfile.ZipFile(io.BytesIO(given["media"])) as old:
        assert new.namelist() == old.namelist() and new.testzip() is None
        assert new.read("word/media/image1.png").decode() == large and b"TBD" not in new.read("word/document.xml")
    assert got["media"][1] is None
    for name in ("main", "header", "junk", "empty", "torn"):
        assert got[name][0] == given[name] and got[name][1]
    assert got["main"][1] == "word/document.xml: member too large" and got["torn"][1] == "not a package: BadZipFile"
    alone = {r["pkg_id"]: r for r in P.pack(P.unpack(packages)).collect()}
    assert all(alone[name]["content"] is None and alone[name]["error"] for name in ("media", "main", "header", "junk", "torn"))


def test_orphaned_large_media_stay_out(spark, monkeypatch):
    monkeypatch.setattr(P, "LARGEST_MEMBER", 2000)
    packages = frame(spark, a=package(f"<w:p>{run('text')}</w:p>", **{"word/media/image1.png": "x" * 5000}))
    row = P.pack(api.deep_clean(P.unpack(packages), operations=["media"]).parts, packages).first()
    with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
        assert row["error"] is None and "word/media/image1.png" not in z.namelist() and "word/document.xml" in z.namelist()


MORE = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def test_equations_and_drawings_are_no_text(spark):
    """Only the document's own paragraphs, runs and texts count; others of the same local names are left alone."""
    math = f"<m:oMath {MORE}><m:r><m:t>[TBD]</m:t></m:r><m:r/></m:oMath>"
    drawn = f"<w:drawing {MORE}><a:p><a:r><a:t>NOTE TO SPECIFIER: x</a:t></a:r></a:p></w:drawing>"
    cases = frame(spark, math=package(f"<w:p>{run('a plain line')}{math}</w:p>"), drawn=package(f"<w:p>{run('kept')}</w:p>{drawn}"))
    cleaned = api.shallow_clean(P.unpack(cases))
    assert cleaned.cuts.count() == 0 and cleaned.detections.count() == 0
    assert api.deep_clean(P.unpack(cases), operations=("empty",)).cuts.count() == 0


def test_the_first_property_counts(spark):
    props = '<w:rPr><w:color/><w:color w:val="FF0000"/><w:i/></w:rPr><w:rPr><w:b/><w:sz w:val="30"/></w:rPr>'
    body = f'<w:p><w:pPr><w:pStyle w:val="One"/><w:pStyle w:val="Two"/></w:pPr><w:r>{props}<w:t>x<w:br/>y</w:t></w:r></w:p>'
    paragraphs, runs = P.paragraphs_and_runs(P.shred(P.unpack(frame(spark, a=package(body), b=package(body)))).repartition(5))
    assert [(r["pstyle"], r["txt"]) for r in paragraphs.collect()] == [("One", "x")] * 2
    assert [(r["color"], r["italic"], r["bold"], r["size"]) for r in runs.collect()] == [(None, True, False, None)] * 2
    style = '<w:style w:styleId="A"><w:basedOn/><w:basedOn w:val="B"/><w:name w:val="First"/><w:name w:val="Second"/></w:style>'
    nodes = P.shred(P.unpack(frame(spark, a=package("", **{"word/styles.xml": f"<w:styles {W}>{style}</w:styles>"})))).repartition(5)
    assert [(r["name"], r["based_on"]) for r in api.style_definitions(nodes).collect()] == [("First", None)]


def test_one_pass_equals_splicing_and_packing(spark):
    cases = frame(spark, a=package(f"<w:p>{run('© 2020')}</w:p><w:p>{run('stays')}</w:p>"), junk=b"no zip", clean=package(f"<w:p>{run('x')}</w:p>"))
    for cleaned in (api.shallow_clean(P.unpack(cases)), api.deep_clean(P.unpack(cases))):
        both = [{r["pkg_id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in df.collect()} for df in (cleaned.packages(cases), P.pack(cleaned.parts, cases))]
        assert both[0] == both[1] and both[0]["junk"][0] == b"no zip"


def test_wanted_elements_equal_those_of_all(spark):
    body = f'<w:p>{run("a")}<w:hyperlink r:id="rId1">{run("b", HIDDEN)}</w:hyperlink><w:r><w:txbxContent><w:p>{run("c")}</w:p></w:txbxContent></w:r></w:p>'
    parts = P.unpack(frame(spark, a=package(body), broken=package("<w:p>")))
    columns = ("pkg_id", "part", "node_id", "last_desc_id", "name", "txt", "hidden", "paras", "previous_id", "b0", "b1", "error")
    every = P.shred(parts).where("name IN ('w:p', 'w:r') OR attrs['r:id'] = 'rId1' OR error IS NOT NULL").select(*columns).collect()
    some = P.shred(parts, ("w:p", "w:r"), columns, references=True).select(*columns).collect()
    assert sorted(map(str, some)) == sorted(map(str, every)) and len(every) == 8
    assert [r["part"] for r in P.shred(parts, ()).collect()] == ["word/document.xml"]


def test_plain_archives_are_read_as_zipfile_does():
    everything = lambda name: True
    made = P.archive([("a.xml", b"x" * 1000), ("é/", b""), ("é.bin", b""), ("b.png", b"1")])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None
        want = [(i.filename, n, i.file_size, z.read(i), None) for n, i in enumerate(z.infolist()) if not i.is_dir()]
    assert P.plain_members(made, everything, True, 1 << 20) == want == P.members_of(made, everything, True, 1 << 20)
    assert [(r[3], r[4]) for r in P.members_of(made, everything, True, 500)][0] == (None, "member too large")
    for wrong in (made[:-1], made[:40] + b"?" + made[41:], b"x" + made, made + b"x", b"", package("", word__x=b"1").replace(b"word/document", b"word/documenT", 1)):
        assert P.plain_members(wrong, everything, True, 1 << 20) is None


def test_derived_packages_take_one_pass(spark):
    from winnower.plans import specimens

    plan = specimens.packages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_a_clean_works_detections_out_once_and_stores_parts_once(spark):
    from winnower.functions.scratch import materialize

    parts = materialize(P.unpack(frame(spark, a=package(f"<w:p>{run('[TBD]')}{run('x', HIDDEN)}</w:p>"))), "parts")
    cleaned = api.shallow_clean(parts)
    assert cleaned.source is parts and materialize(parts, "again") is parts
    assert "RLIKE" not in cleaned.detections._jdf.queryExecution().optimizedPlan().toString().upper()
    assert "Window" not in api.previous_siblings(P.shred(parts))._jdf.queryExecution().optimizedPlan().toString()


def test_closures_of_many_packages_stay_apart(spark):
    from winnower.operators import styles

    edges = spark.range(3000).selectExpr("id % 1000 AS pkg_id", "concat('s', id div 1000) AS src", "concat('s', (id div 1000 + 1) % 3) AS dst")
    seeds = spark.range(0, 1000, 2).selectExpr("id AS pkg_id", "'s0' AS dst")
    plan = styles.closure_of_edges(edges, seeds)
    assert plan.groupBy("pkg_id").count().where("count = 3 AND pkg_id % 2 = 0").count() == 500 == plan.count() / 3
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_share_a_task(spark, tmp_path):
    from winnower.streaming.watch import gathered

    for i in range(200):
        (tmp_path / f"{i}.docx").write_bytes(b"x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
        got = gathered(files)
        assert files.rdd.getNumPartitions() >= 100 and got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        assert got.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
