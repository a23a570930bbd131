"""Runs over archives: events of every stage, failures of one archive alone, and what views and questions must meet."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.operators import status
from quarrymap.plans import demo, jobs
from quarrymap.sources import repositories as repos


def last_events(spark, target):
    events = spark.read.parquet(f"{target}/events")
    ids = events.select("analysis_id").distinct()
    return {r.analysis_id: r for r in status.with_status(ids, events).collect()}, events


def test_bad_archives_fail_alone(spark, tmp_path):
    target = str(tmp_path / "run")
    many = [("many", "many.zip", demo.zip_bytes({f"{k}.py": "" for k in range(3)}))]
    frame = demo.bad_archives(spark).unionByName(spark.createDataFrame(many, demo.ARCHIVES))
    jobs.run_archives(frame, target, Config(max_extracted_files=3, max_extracted_bytes=400, max_python_files=2))
    last, events = last_events(spark, target)
    assert {k: (r.status, r.stage, r.error_code) for k, r in last.items()} == {
        "good": ("completed", "complete", None), "links": ("failed", "downloading_source", "INVALID_ARCHIVE"), "climbs": ("failed", "downloading_source", "INVALID_ARCHIVE"), "junk": ("failed", "downloading_source", "INVALID_ARCHIVE"),
        "crowd": ("failed", "downloading_source", "REPOSITORY_TOO_LARGE"), "heavy": ("failed", "downloading_source", "REPOSITORY_TOO_LARGE"), "many": ("failed", "scanning_files", "REPOSITORY_TOO_LARGE"),
    }
    assert last["good"].progress == 100 and last["many"].error_message == "Too many Python files for analysis."
    assert [r.stage for r in events.filter("analysis_id = 'good'").orderBy("seq").collect()] == [s for s, _ in status.STAGES]
    assert {r.analysis_id for r in spark.read.parquet(f"{target}/files").collect()} == {"good"}
    gated = status.completed(spark.createDataFrame([("good",), ("many",)], "analysis_id string"), status.with_status(events.select("analysis_id").distinct(), events))
    assert [r.analysis_id for r in gated.collect()] == ["good"]


def test_an_unexpected_error_is_recorded_and_raised(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise RuntimeError("disk gone")

    monkeypatch.setattr(jobs, "analyze", broken)
    with pytest.raises(RuntimeError, match="disk gone"):
        jobs.run_archives(demo.bad_archives(spark), str(tmp_path / "run"))
    last, _ = last_events(spark, str(tmp_path / "run"))
    assert (last["good"].status, last["good"].stage, last["good"].error_code, last["good"].error_message) == ("failed", "scanning_files", status.UNEXPECTED, status.UNEXPECTED_MESSAGE)
    assert last["junk"].error_code == "INVALID_ARCHIVE"


def test_limits_hold_before_members_are_read(monkeypatch):
    read = []
    members = [("top/a.py", 10, "file", lambda: read.append("a")), ("top/b.py", 1 << 40, "file", lambda: read.append("b"))]
    assert repos.first_fault(members, Config()) == ("top/b.py", "large") and read == []
    assert repos.first_fault(members[:1], Config()) is None
    assert repos.first_fault([("top/a.py", 1, "file", bytes)] * 3, Config(max_extracted_files=2)) == ("top/a.py", "many")
    assert repos.first_fault([("top/../../x", 1, "file", bytes)], Config())[1] == "unsafe"
    assert repos.first_fault([("only", 1, "file", bytes)], Config(max_extracted_files=0)) is None  # below no top folder


def test_a_faulty_archive_gives_no_files(spark):
    limits = Config(max_extracted_files=3, max_extracted_bytes=400)
    members = repos.archive_members(demo.bad_archives(spark), limits)
    assert {r.analysis_id for r in repos.checked_members(members, limits, drop=True).collect()} == {"good"}
    with pytest.raises(PySparkException):
        repos.checked_members(members, limits).collect()


def test_questions_and_display(spark):
    rows = spark.createDataFrame([(None, None), ("ab", ""), ("abc", "0123456789"), ("x" * 2000, "abc"), ("x" * 2001, "a")], "q string, sha string")
    got = rows.select(status.askable(F.col("q")).alias("ok"), status.short_sha(F.col("sha")).alias("sha")).collect()
    assert [r.ok for r in got] == [False, False, True, True, False] and [r.sha for r in got] == ["—", "—", "0123456", "abc", "a"]
    shown = spark.sql("SELECT timestamp'2024-01-05 15:07:00' AS at UNION ALL SELECT NULL").select(status.shown_date(F.col("at")).alias("d")).collect()
    assert {r.d for r in shown} == {"Jan 5, 2024, 3:07 PM", "—"}


def test_header_of_a_queued_analysis_without_repository(spark):
    analyses = spark.createDataFrame([("a", "r1"), ("b", "gone")], "analysis_id string, repository_id string")
    events = spark.createDataFrame([], status.EVENT)
    out = status.headers(status.with_status(analyses, events), spark.createDataFrame([("r1", "o/n")], "repository_id string, full_name string"), spark.createDataFrame([("a", 3)], "analysis_id string, files int"))
    got = {r.analysis_id: r for r in out.collect()}
    assert got["a"].status == "queued" and got["a"].progress == 0 and got["a"].repository.full_name == "o/n" and got["a"].statistics.files == 3
    assert got["b"].repository is None and got["b"].statistics is None
