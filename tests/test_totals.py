import os

from test_packages import W, package, run

from winnower.streaming.totals import totals, watch_totals


def test_totals_follow_the_latest_delivery(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def deliver(name, content, at):
        (inbox / f"{name}.docx").write_bytes(content)
        os.utime(inbox / f"{name}.docx", (at, at))

    def now():
        watch_totals(spark, str(inbox), out, state).awaitTermination()
        return {r["content_type"]: (r["n"], r["docs"]) for r in totals(spark, out).collect()}

    tbd, note = f"<w:p>{run('[TBD]')}</w:p>", f"<w:p>{run('NOTE TO SPECIFIER: x')}</w:p>"
    deliver("a%20b@1", package(tbd + tbd), 1000)
    deliver("c", package(tbd + note), 1000)
    deliver("broken", package("<w:p>"), 1000)
    deliver("junk", b"no zip", 1000)
    deliver("plain", package(f"<w:p>{run('text')}</w:p>"), 1000)
    assert now() == {"editorial_artifact": (3, 2), "specifier_note": (1, 1)}
    deliver("a%20b@2", package(note), 3000)  # replaces two findings by one
    deliver("a%20b@3", package(tbd), 2000)  # written before that, though it comes with it
    deliver("c@2", b"torn", 3000)  # can't be read
    deliver("broken@2", package(tbd), 3000)
    assert now() == {"editorial_artifact": (2, 2), "specifier_note": (2, 2)}
    deliver("a%20b@4", package(tbd * 9), 500)  # older than what counts
    deliver("c@3", package("", **{"word/header1.xml": f"<w:hdr {W}></w:hdr>"}), 4000)  # nothing left
    assert now() == {"editorial_artifact": (1, 1), "specifier_note": (1, 1)}
    assert now() == {"editorial_artifact": (1, 1), "specifier_note": (1, 1)}  # a restart without anything new
