"""Outputs under a manifest, killed and concurrent writers, and a log that a pass may write again."""

import threading

import pytest
from pyspark.sql import functions as F

from tilewright.sources import sinks

SCHEMA = "slide_id string, fov_id int, score double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def out(spark, tmp_path):
    return sinks.Committed(spark, str(tmp_path / "out"), SCHEMA)


def test_a_writer_killed_between_files_leaves_the_old_state(spark, out, tmp_path):
    old = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 1.0)], SCHEMA)
    assert out.read().count() == 0 and out.manifest().count() == 0
    out.write(old)
    new = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 9.0), ("a", 3, 9.0)], SCHEMA)
    # Some tasks have written their files when one of them fails.
    broken = new.repartition(3, "fov_id").withColumn("score", F.when(F.col("fov_id") == 3, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="killed"):
        out.write(broken)
    assert rows_of(out.read()) == rows_of(old)
    # All files are in place, and the writer ends before it commits.
    version = out.stage(new)
    assert rows_of(out.read()) == rows_of(old)
    out.commit(version)
    assert rows_of(out.read()) == sorted([*map(tuple, new.collect()), ("b", 1, 1.0)])


def test_two_writers_of_a_slide_leave_one(spark, out):
    make = lambda k: spark.createDataFrame([("a", i, float(k)) for i in range(20 + k)], SCHEMA).repartition(4)
    threads = [threading.Thread(target=out.write, args=(make(k),)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = out.read().collect()
    assert len({r.score for r in rows}) == 1 and len(rows) == 20 + int(rows[0].score)
    first, second = out.stage(make(1)), out.stage(make(2))
    out.commit(second)
    out.commit(first)  # the later version counts, whichever is named last
    assert {r.score for r in out.read().collect()} == {2.0}


def test_resume_reads_the_manifest_alone(spark, out):
    out.write(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 1.0), (None, 1, None)], SCHEMA), spark.createDataFrame([("c",), ("a",)], "slide_id string"))
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0), ("d", 1)], "slide_id string, n_expected long")
    assert sorted(r.slide_id for r in out.unfinished(wanted).collect()) == ["b", "d"]
    assert {r.slide_id: r.n_rows for r in out.manifest().collect()} == {"a": 2, "b": 1, "c": 0, None: 1}
    read = out.unfinished(wanted).inputFiles()
    assert read and all("/out/manifest/" in f for f in read)
    # A slide that is written anew with fewer rows has only those.
    out.write(spark.createDataFrame([("a", 7, 0.5)], SCHEMA))
    assert rows_of(out.read().where("slide_id = 'a'")) == [("a", 7, 0.5)]


def test_files_of_versions_that_do_not_count_are_not_read(spark, out):
    for k in range(3):
        out.write(spark.createDataFrame([("a", i, float(k)) for i in range(4)], SCHEMA))
    assert {r.score for r in out.read().collect()} == {2.0}


def test_a_batch_that_is_logged_again_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 2), ("b", 3)], "slide_id string, n int")
    for batch in ("day 1", "day 1", "day/2"):
        sinks.append_log(rows, path, batch)
    sinks.append_log(rows.limit(1), path, "day/2")
    got = sinks.read_log(spark, path, ["slide_id string", "n int"])
    assert sorted((r.batch, r.slide_id, r.n) for r in got.collect())[:2] == [("day 1", "a", 2), ("day 1", "b", 3)] and got.count() == 3
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    got = sinks.read_log(spark, path, ["slide_id string", "n int"])
    assert got.count() == 7 and got.where("ts > 0").count() == 7


def test_workbooks_go_through_their_files(spark, tmp_path):
    from tilewright.sources import files

    rows = [(f"s{i}", None if i % 3 == 0 else f' a<&>"{i} ', *(str(i) if k == 27 else None for k in range(28))) for i in range(50)]
    names = ["slide_id", "note", *(f"c{k}" for k in range(28))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert sinks.write_workbooks(df.repartition(3), str(tmp_path / "books"), 'A "B" & C') == 3
    got = files.workbook(spark, str(tmp_path / "books"), 'A "B" & C', "slide_id", {"A": "slide_id", "B": "note", "AD": "last"})
    assert rows_of(got.select("slide_id", "note", "last")) == sorted(((r[0], r[1], r[-1]) for r in rows), key=str)
    assert got.agg(F.min("row")).head()[0] == 2
