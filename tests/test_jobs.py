"""The jobs: against SQL, run again, run over growing copies, cut short, from the command line."""

import json
import logging
import re
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, queries, score_slides, watch_texts
from tests.test_library import TABLES, plain

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql_after_two_runs(spark, con, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert before == {k: spark.conf.get(k, None) for k in before}


def rows_of(df):
    return sorted(df.collect(), key=str)


def settings(spark, job, **more):
    return {**common.read_config(spark, job.CONFIG, job.DEFAULTS), **more}


def test_scores_of_one_site_leave_the_others_as_they_are(spark, tmp_path):
    out, config = str(tmp_path / "out"), settings(spark, score_slides)
    score_slides.run(spark, SMALL, out, config)
    fields, slides = (rows_of(x) for x in score_slides.read_back(spark, out))
    kept = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}
    site = slides[0].site
    moved = score_slides.run(spark, SMALL, out, {**config, "sites": [site], "thresholds": [0.0, 0.1, 0.2, 0.3]})
    now, per = (rows_of(x) for x in score_slides.read_back(spark, out))
    assert [r for r in now if r.site != site] == [r for r in fields if r.site != site]
    assert moved == {"fields": sum(r.site == site for r in fields), "slides": sum(r.site == site for r in slides)}
    assert [r for r in now if r.site == site] != [r for r in fields if r.site == site]
    assert len(per) == len(slides)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in kept.items() if f"site={site}" not in str(p))
    score_slides.run(spark, SMALL, out, config)
    assert [rows_of(x) for x in score_slides.read_back(spark, out)] == [fields, slides]
    with pytest.raises(ValueError, match="no slides of: Nowhere"):
        score_slides.run(spark, SMALL, out, {**config, "sites": [site, "Nowhere"]})


def put(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(folder)


def naive(rows):
    """(source, doc_id) -> (words, lines, z, bad) by plain medians."""
    median = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    by = {}
    for k, text, _, source, n in rows:
        t = text or ""
        by.setdefault(source or None, []).append((k, len(re.findall(r"[^\x20\x09-\x0D]+", t)), sum(bool(x.strip()) for x in t.split("\n")), "no_text" if text is None else "wrong_length" if n != len(t) else ""))
    out = {}
    for source, own in by.items():
        m = median([x[1] for x in own])
        mad = median([abs(x[1] - m) for x in own]) * 1.4826
        for k, n, lines, bad in own:
            out[source, k] = (n, lines, (n - m) / mad if mad else None, bad)
    return out


def stands_for(spark, out, rows):
    fields, sources = watch_texts.read_back(spark, out)
    got = {(r.source, r.doc_id): r for r in fields.collect()}
    want = naive(rows)
    assert got.keys() == want.keys()
    for k, (n, lines, z, bad) in want.items():
        r = got[k]
        assert (r.n_detected, r.n_lines) == (n, lines) and (r.z is None) == (z is None) and (z is None or abs(r.z - z) < 1e-9)
        assert (bad or "-") in [*r.flags.split(";"), "-"] and ("high_outlier" in r.flags.split(";")) == (z is not None and z >= 2)
    per = {r.source: r for r in sources.collect()}
    assert {s: r.n_fovs for s, r in per.items()} == {s: sum(k[0] == s for k in want) for s in {k[0] for k in want}}
    assert sum(r.n_bad for r in per.values()) == sum(bool(v[3]) for v in want.values())


FIRST = [(i, "w " * (5 + i % 4), "en", f"s{i % 3}", 2 * (5 + i % 4)) for i in range(40)] + [(100, None, None, None, None), (101, "", "en", "", 0), (102, "one\n \ntwo", "de", "a=b/c %é", 9)]
SECOND = [(200, "w " * 400, "en", "s1", 800), (201, "x", "en", "new", 5), (202, "é ß", None, None, 3), (102, "one\n \ntwo", "de", "a=b/c %é", 9)]


def test_texts_are_taken_once_over_growing_input(spark, tmp_path, caplog):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    config = settings(spark, watch_texts)
    put(spark, FIRST, src)
    with caplog.at_level(logging.INFO, "jobs"):
        assert watch_texts.run(spark, src, out, mark, config) == {"batches": 1, "texts": len(FIRST), "fields": len(FIRST), "sources": 5}
    assert f"read {len(FIRST)} texts" in caplog.text and f"wrote {len(FIRST)} rows to {out}/fields" in caplog.text
    stands_for(spark, out, FIRST)
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}
    assert watch_texts.run(spark, src, out, mark, config)["batches"] == 0
    assert files == {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}
    put(spark, SECOND[:3], src)
    got = watch_texts.run(spark, src, out, mark, config)
    # New texts are read alone; fields are written again for their sources only.
    assert (got["batches"], got["texts"], got["sources"]) == (1, 3, 3)
    stands_for(spark, out, FIRST + SECOND[:3])
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items() if "/fields/source=s0" in str(p) or "/fields/source=s2" in str(p))


def test_a_batch_that_was_cut_short_is_taken_again_whole(spark, tmp_path, monkeypatch):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    config = settings(spark, watch_texts)
    put(spark, FIRST, src)
    watch_texts.run(spark, src, out, mark, config)
    put(spark, SECOND[:2], src)
    summed = watch_texts.summed
    monkeypatch.setattr(watch_texts, "summed", lambda rows: 1 / 0)
    with pytest.raises(Exception, match="division by zero|ZeroDivision"):
        watch_texts.run(spark, src, out, mark, config)
    monkeypatch.setattr(watch_texts, "summed", summed)
    assert watch_texts.run(spark, src, out, mark, config)["texts"] == 2
    stands_for(spark, out, FIRST + SECOND[:2])


def test_many_files_go_in_several_batches_and_a_new_checkpoint_starts_over(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [FIRST[:15], FIRST[15:30], FIRST[30:], SECOND[:3]]
    for part in rows:
        put(spark, part, src)
    config = settings(spark, watch_texts, files_at_once=1)
    assert watch_texts.run(spark, src, out, str(tmp_path / "a"), config)["batches"] == 4
    stands_for(spark, out, sum(rows, []))
    assert watch_texts.run(spark, src, out, str(tmp_path / "b"), {**config, "files_at_once": 9})["batches"] == 1
    stands_for(spark, out, sum(rows, []))


def test_real_documents_in_two_halves_are_as_one(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    config = settings(spark, watch_texts)
    for half in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")):
        half.coalesce(2).write.mode("append").parquet(src)
        watch_texts.run(spark, src, out, str(tmp_path / "mark"), config)
    whole = str(tmp_path / "whole")
    watch_texts.run(spark, f"{SMALL}/documents.parquet", whole, str(tmp_path / "mark2"), config)
    for a, b in zip(watch_texts.read_back(spark, out), watch_texts.read_back(spark, whole), strict=True):
        assert rows_of(a) == rows_of(b)


def test_settings_and_empty_tables(spark, tmp_path):
    bad = tmp_path / "c.json"
    bad.write_text(json.dumps({"outlier": 3, "nonsense": 1}))
    with pytest.raises(ValueError, match="unknown settings: nonsense"):
        common.read_config(spark, str(bad), watch_texts.DEFAULTS)
    bad.write_text(json.dumps({"outlier": 3}))
    for path in (str(bad), f"file://{bad}"):
        assert common.read_config(spark, path, watch_texts.DEFAULTS) == {**watch_texts.DEFAULTS, "outlier": 3}
    put(spark, [], str(tmp_path / "none"))
    assert watch_texts.run(spark, str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "mark"), {})["texts"] == 0


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line parses, reads its settings and hands its session on; the session itself is the tests' own here."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs")
    out = str(tmp_path / "o1")
    score_slides.main(["--tables", SMALL, "--out", out, "--config", str(tmp_path / "jobs" / "score_slides.json")])
    assert score_slides.read_back(spark, out)[1].count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count()
    out = str(tmp_path / "o2")
    watch_texts.main(["--documents", f"{SMALL}/documents.parquet", "--out", out, "--checkpoint", str(tmp_path / "m")])
    assert watch_texts.read_back(spark, out)[0].count() == spark.read.parquet(f"{SMALL}/documents.parquet").agg(F.count("*")).head()[0]
    with pytest.raises(SystemExit):
        watch_texts.main(["--out", out])


def test_jobs_do_not_name_the_text_package():
    for p in (ROOT / "jobs").glob("*.py"):
        assert not re.search(r"\bllm\b|corpus_pipeline", p.read_text()), p
