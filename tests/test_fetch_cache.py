"""Files fetched into a cache: nothing is read twice, changed files are read again, failures are tried again."""

import os

from tilewright.sources import fetch, files


def test_a_second_run_reads_nothing_and_a_changed_file_is_read_again(spark, tmp_path):
    src, log = tmp_path / "src", tmp_path / "log"
    (src / "deep").mkdir(parents=True)
    for i in range(5):
        (src / f"f {i}.bin").write_bytes(b"x" * i or b"y")
    (src / "deep" / "g.bin").write_bytes(b"same")

    def read(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return fetch.read_whole(path)

    reads = lambda: sorted(log.read_text().split("\n")[:-1]) if log.exists() else []
    listing = lambda: files.file_list(spark, str(src))
    cache = fetch.FetchCache(spark, str(tmp_path / "cache"))
    assert cache.fetch(listing(), read=read) == 6 and len(reads()) == 6
    assert cache.fetch(listing(), read=read) == 0 and len(reads()) == 6
    assert all("/cache/" in f and "/src/" not in f for f in cache.missing(listing()).inputFiles() if f.endswith(".parquet"))
    (src / "f 3.bin").write_bytes(b"abc")  # of the same length, at another time
    os.utime(src / "f 3.bin", (1, 2_000_000_000))
    (src / "new.bin").write_bytes(b"n")
    assert cache.fetch(listing(), read=read) == 2 and len(reads()) == 8
    got = {os.path.basename(r.path): r for r in cache.read(listing()).collect()}
    assert len(got) == 7 and bytes(got["f%203.bin" if "f%203.bin" in got else "f 3.bin"].content) == b"abc" and bytes(got["g.bin"].content) == b"same"
    assert all(r.error is None and len(r.digest) == 64 and set(r.name) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-") for r in got.values())
    fresh = fetch.FetchCache(spark, str(tmp_path / "cache"))
    assert fresh.fetch(listing(), read=read) == 0


def test_a_file_that_failed_is_tried_again(spark, tmp_path):
    src, bad = tmp_path / "src", tmp_path / "bad"
    src.mkdir()
    bad.write_text("")
    for n in ("a", "b"):
        (src / n).write_bytes(n.encode())

    def read(path):
        if path.endswith("b") and bad.exists():
            raise PermissionError("not yet")
        return fetch.read_whole(path)

    cache = fetch.FetchCache(spark, str(tmp_path / "cache"))
    listing = lambda: files.file_list(spark, str(src))
    assert cache.fetch(listing(), read=read, delay=0) == 2
    assert {os.path.basename(r.path): r.error for r in cache.read(listing()).collect()} == {"a": None, "b": "PermissionError: not yet"}
    assert cache.fetch(listing(), read=read, delay=0) == 1
    bad.unlink()
    assert cache.fetch(listing(), read=read, delay=0) == 1 and cache.fetch(listing(), read=read) == 0
    assert {bytes(r.content) for r in cache.read(listing()).collect()} == {b"a", b"b"}
