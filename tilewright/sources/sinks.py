"""Writers: whole outputs per slide, logs, parameters, and which slides are done."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import matched, written
from ..storage import write_files


#: Folders that slides are dealt to by hash; an output is bound to this number.
PARTS = 128


def write_slides(rows: DataFrame, path: str, slide: str = "slide_id", form: str = "parquet") -> None:
    """Replace the outputs of the slides in ``rows`` and no others; a slide's rows are in one place, so it has few files.

    Slides share PARTS folders (slide_part), so that folders and files do not grow with the slides. Of the
    folders that have slides of ``rows``, the other slides' rows are written again.
    """
    spark = rows.sparkSession
    new = written(rows.withColumn("slide_part", F.pmod(F.xxhash64(F.col(slide).cast("string")), F.lit(PARTS)).cast("int")), "slides")
    how = {"header": "true", "multiLine": "true"} if form == "csv" else {}
    try:
        old = spark.read.schema(new.schema).format(form).options(**how).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:  # written elsewhere first, as what is read is replaced
        beside = old.join(new.select("slide_part").distinct(), "slide_part", "left_semi")
        kept = matched(beside, new.select(slide).distinct(), [slide], "left_anti")
        new = written(new.unionByName(kept), "slides")
    new.repartition("slide_part").write.mode("overwrite").partitionBy("slide_part").option("partitionOverwriteMode", "dynamic").options(**how).format(form).save(path)


class Committed:
    """Slides' outputs that count only once the manifest names them.

    Rows go to ``data`` in a folder of the version that wrote them, and when all its files are in place a row for
    each slide (slide, version, n_rows) is added to ``manifest``. Readers take from each slide the version
    that the manifest names last, so a writer that is killed before the end leaves the state before it, of two
    writers of a slide one counts, and a slide never is a mixture. Whether a slide is done is read from the
    manifest alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, slide: str = "slide_id"):
        self.spark, self.path, self.slide = spark, path.rstrip("/"), slide
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, rows: DataFrame, wanted: DataFrame | None = None) -> str:
        """Write the rows of whole slides; returns the version. Slides of ``wanted`` without rows are committed with none.

        What the manifest says is counted in the files that were written, not in a plan that might be run
        again and differ.
        """
        version = self.stage(rows)
        self.commit(version, wanted)
        return version

    def stage(self, rows: DataFrame) -> str:
        """The files of a new version, which nothing names yet; later versions have larger names."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        # A folder for each version: writers of one folder share the files in progress, and the first to end clears them away.
        rows.select(*cols).hint("rebalance", self.slide).write.parquet(f"{self.path}/data/version={version}")
        return version

    def commit(self, version: str, wanted: DataFrame | None = None) -> None:
        n = self._data().where(F.col("version") == version).groupBy(self.slide).agg(F.count(F.lit(1)).alias("n_rows"))
        if wanted is not None:
            n = wanted.select(self.slide).distinct().join(n, self.slide, "full")
        n.select(self.slide, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")).hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def versions(self) -> DataFrame:
        """(slide, version, n_rows) of all versions that were committed, those that no longer count too."""
        own = T.StructType([T.StructField(self.slide, self.schema[self.slide].dataType), T.StructField("n_rows", T.LongType()), T.StructField("version", T.StringType())])
        return _read(self.spark, f"{self.path}/manifest", own)

    def staged(self, version: str) -> DataFrame:
        """The rows of one version, whether it counts or not."""
        return self._data().where(F.col("version") == version).select(*self.schema.names)

    def manifest(self) -> DataFrame:
        """(slide, version, n_rows) of the version of each slide that counts."""
        return self.versions().groupBy(self.slide).agg(F.max("version").alias("version"), F.max_by("n_rows", "version").alias("n_rows"))

    def read(self) -> DataFrame:
        """The rows of every slide's version that counts; files of other versions are not read."""
        return self._data().join(self.manifest().select(self.slide, "version"), [self.slide, "version"], "left_semi").select(*self.schema.names)

    def unfinished(self, wanted: DataFrame, expected: str = "n_expected") -> DataFrame:
        """The wanted slides that are not committed with the expected number of rows."""
        have = self.manifest().select(self.slide, F.col("n_rows").alias(expected))
        return wanted.join(have, [self.slide, expected], "left_anti")

    def _data(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/data", T.StructType([*self.schema.fields, T.StructField("version", T.StringType())]))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files at ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows as JSON lines, with the time of writing.

    ``batch`` names what is logged: rows logged before under that name are replaced, so a pass that is run
    again is in the log once. Without a name the rows are added in any case.
    """
    named = rows.withColumn("ts", F.unix_timestamp()).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def read_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The log's rows with the given columns ("name type"), ts and batch."""
    return spark.read.schema(", ".join([*columns, "ts long", "batch string"])).json(path)


def split_failed(rows: DataFrame, slide: str = "slide_id", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows of slides that count as done, failed slides with their numbers of rows and errors): more than max(3, 5 %) errors fail a slide."""
    bad = F.coalesce(F.trim(error), F.lit("")) != ""
    per = rows.groupBy(slide).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("errors"))
    failed = per.where(F.col("errors") > F.greatest(F.lit(3.0), 0.05 * F.col("n")))
    return rows.join(failed.select(slide), slide, "left_anti"), failed


def unfinished(wanted: DataFrame, written: DataFrame, slide: str = "slide_id", expected: str = "n_expected") -> DataFrame:
    """The wanted slides that have no output or one of another number of rows."""
    have = written.groupBy(slide).agg(F.count(F.lit(1)).alias(expected))
    return wanted.join(have, [slide, expected], "left_anti")


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def mirror(rows: DataFrame, path: str, second: str) -> str | None:
    """Write to ``path``, then the same files' rows to ``second``; a failure there is returned, not raised."""
    rows.write.mode("overwrite").parquet(path)
    try:
        rows.sparkSession.read.parquet(path).write.mode("overwrite").parquet(second)
    except Exception as e:
        return f"{type(e).__name__}: {e}"[:200]
    return None


def markdown(rows: DataFrame, title: str, most: int = 1_000) -> str:
    """A small aggregate as a Markdown table; more than ``most`` rows are an error, as a report is no export."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(rows.columns), line("-" for _ in rows.columns), *map(line, got)]) + "\n"


_BOOK = {
    "xl/workbook.xml": '<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="{sheet}" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="{p}"><Relationship Id="rId1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "_rels/.rels": '<Relationships xmlns="{p}"><Relationship Id="rId1" Type="{r}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "[Content_Types].xml": '<Types xmlns="{c}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
}
_NAMES = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships", "c": "http://schemas.openxmlformats.org/package/2006/content-types"}


def sheet_bytes(sheet: str, header: Sequence[str], rows: Sequence[Sequence[object]]) -> bytes:
    """A workbook with one sheet of text cells below a header; cells without a value are left out."""
    letter = lambda k: ("" if k < 26 else letter(k // 26 - 1)) + chr(65 + k % 26)
    cell = lambda n, k, v: f'<c r="{letter(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    body = "".join(f'<row r="{n}">' + "".join(cell(n, k, v) for k, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate([header, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, form in _BOOK.items():
            z.writestr(name, form.format(sheet=escape(sheet, {'"': "&quot;"}), **_NAMES))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NAMES["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_workbooks(rows: DataFrame, folder: str, sheet: str) -> int:
    """Write ``rows`` as workbooks, each of the rows that a task holds at a time; returns how many. Values are written as text."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            content = sheet_bytes(sheet, names, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([f"book-{part:05d}-{k:05d}.xlsx"]), pa.array([content], pa.binary())], names=["name", "content"])

    return write_files(rows.select(*(F.col(c).cast("string") for c in names)).mapInArrow(run, "name string, content binary"), folder)
