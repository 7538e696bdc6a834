"""The folder that the driver and all executors share, and files written there by tasks."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share (``spark.checkpoint.dir``).

    Where it is unset, a local session, whose driver runs the tasks, gets a temporary folder, one for
    each application; on a cluster no folder of one machine would do, and that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="shared-")
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it; names are as Spark shows them, with spaces and all."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace(" ", "%20"))
    return pafs.LocalFileSystem(), str(Path(path).absolute())


def write_files(files: DataFrame, folder: str) -> int:
    """Write one file for each row (name string, content binary) below ``folder``; returns how many.

    A file is written under another name and moved, so a task that is run again replaces whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = posixpath.join(root, name)
                fs.create_dir(posixpath.dirname(path), recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}.partial"
                with fs.open_output_stream(draft) as out:
                    out.write(content)
                fs.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    got = files.select("name", "content").mapInArrow(run, "n long").selectExpr("coalesce(sum(n), 0)").head()
    return int(got[0])
