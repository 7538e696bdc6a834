"""Neighbours by event time under shuffled arrival, late fields, repeated fields, and a stream that is stopped and goes on."""

import random
from datetime import datetime, timedelta

from tilewright.streaming import neighbours

SCHEMA = "slide_id long, fov_id long, ts timestamp, value double"
START = datetime(2024, 1, 1)


def plain(rows):
    out, near = [], {}
    for s, f, t, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = near.setdefault(s, [])
        values = [x for _, x in own if x is not None]
        rise = None if v is None else v - max(values, default=v)
        out.append((s, f, ",".join(str(k) for k, _ in own), rise))
        near[s] = [*own, (f, v)][-2:]
    return sorted(out, key=str)


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def got(spark, out):
    return sorted(((r.slide_id, r.fov_id, r.before, r.rise) for r in spark.read.parquet(out).where("slide_id >= 0").collect()), key=str)


def test_shuffled_arrival_over_several_runs_equals_the_walk(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    r = random.Random(2)
    rows = [(r.randrange(4), k, START + timedelta(hours=k), None if k % 9 == 0 else float(r.randrange(50))) for k in range(120)]
    rows += [rows[5], (0, 200, START + timedelta(hours=3), 7.0), (0, 199, START + timedelta(hours=3), 8.0)]
    order = sorted(rows, key=lambda x: x[2] + timedelta(hours=r.randrange(40)))
    for k in range(0, len(order), 45):
        put(spark, order[k : k + 45], src)
        assert neighbours.take_all(spark, src, SCHEMA, "41 hours", out, mark) == 0
    some = got(spark, out)
    assert 0 < len(some) < len(rows) and set(some) <= set(plain(rows))
    spark.sql(neighbours.end_of_stream()).write.mode("append").parquet(src)
    neighbours.take_all(spark, src, SCHEMA, "41 hours", out, mark)
    assert got(spark, out) == plain(rows)
    assert spark.conf.get(neighbours.PROVIDER, None) != neighbours.ROCKSDB


def test_fields_that_come_too_late_are_counted_and_left_out(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = [(1, k, START + timedelta(hours=k), float(k)) for k in range(30)]
    put(spark, [x for x in rows if x[1] != 3], src)
    neighbours.take_all(spark, src, SCHEMA, "5 hours", out, mark)
    put(spark, [rows[3], (1, None, START, 1.0), (None, 1, START, 1.0), (1, 40, None, 1.0)], src)
    spark.sql(neighbours.end_of_stream()).write.mode("append").parquet(src)
    assert neighbours.take_all(spark, src, SCHEMA, "5 hours", out, mark) == 1
    assert got(spark, out) == plain([x for x in rows if x[1] != 3])
