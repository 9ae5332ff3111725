import pytest
from pyspark.sql import functions as F

from winnower.plans import resume


def test_a_killed_run_goes_on_and_changes_are_taken(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/done", []

    def packages(rows):
        return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "pkg_id string, content binary")

    def clean(df, fail=False):
        ids = [r[0] for r in df.select("pkg_id").collect()]
        if fail and len(seen) >= 8:
            raise RuntimeError("killed")
        seen.extend(ids)
        return df.select("pkg_id", F.upper(F.col("content").cast("string")).cast("binary").alias("content"), F.when(F.col("pkg_id") == "p3", "fault").alias("error"))

    rows = [(f"p{i}", f"text {i}".encode()) for i in range(40)]
    with pytest.raises(RuntimeError):
        resume.clean_new(packages(rows), folder, lambda df: clean(df, True), batches=6)
    first = len(seen)
    assert 8 <= first < 40 and resume.results(spark, folder).count() == first
    resume.clean_new(packages(rows), folder, clean, batches=3)
    assert sorted(seen) == sorted(k for k, _ in rows)  # none twice
    assert {(r["pkg_id"], bytes(r["content"])) for r in resume.latest(spark, folder).collect()} == {(k, v.upper()) for k, v in rows}
    seen.clear()
    run = resume.clean_new(packages([("p1", b"other"), *rows[2:], ("new", b"n")]), folder, clean)
    assert sorted(seen) == ["new", "p1"]
    got = {r["pkg_id"]: (bytes(r["content"]), r["run"]) for r in resume.latest(spark, folder).collect()}
    assert got["p1"] == (b"OTHER", run) and got["new"] == (b"N", run) and got["p0"][0] == b"TEXT 0" and len(got) == 41
    resume.clean_new(packages(rows[:2]), folder, clean)  # back to what it was: another change
    assert sorted(seen) == ["new", "p1", "p1"]
