"""Readers: images, listings, catalogues, parameters, detector tables, scan metadata."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import relational

#: Suffixes of images, in either case.
IMAGE_SUFFIXES = ("png", "tif", "tiff", "jpg", "jpeg", "bmp")


def images(spark: SparkSession, path: str, recursive: bool | None = None) -> DataFrame:
    """(path, name, length, content) of all images below a folder; local folders are not searched below unless asked, stores are."""
    deep = path.startswith("gs://") if recursive is None else recursive
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in s) for s in IMAGE_SUFFIXES) + "}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(path)
    return raw.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "content")


def file_list(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of all files below a folder but empty ones; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"))


def image_list(spark: SparkSession, path: str, recursive: bool | None = None) -> DataFrame:
    """(path, name, length) by name: the content column is not read at all."""
    return images(spark, path, recursive).drop("content").orderBy("name")


def classify(blobs: DataFrame, slide: str = "slide_id", name: str = "name") -> DataFrame:
    """Per slide: how many nested, channel and other blobs, the numbers of each channel, and those missing of 1 to ``n``."""
    b = blobs.withColumn("_class", text.blob_class(F.col(name))).withColumn("_n", text.blob_number(F.col(name)))
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("_class") == k, F.col("_n"))))
    out = b.groupBy(slide).agg(*(F.count(F.when(F.col("_class") == k, 1)).alias(f"n_{k}") for k in ("nested", "dpc", "fluorescent", "other")), of("dpc").alias("dpc_ids"), of("fluorescent").alias("fluorescent_ids"))
    gone = lambda c: F.array_except(F.sequence(F.lit(1), F.lit(324)), F.col(c))
    return out.withColumn("dpc_missing", gone("dpc_ids")).withColumn("fluorescent_missing", gone("fluorescent_ids"))


def resolve_folder(samples: DataFrame, folders: DataFrame, sample: str = "sample_id", folder: str = "folder", suffix: str = "_Blue") -> DataFrame:
    """(sample, folder, problem) of samples named <country>-<batch>-<date>-<time>-<id>: the one folder with the suffix whose name has <date>-<time>-<id>.

    The needle is cut out of the folder's name as well, so this is an equi-join, not a search through all pairs.
    """
    key = r"(\d{8}-\d{6}-[^-_]+)"
    s = samples.withColumn("_key", F.nullif(F.regexp_extract(sample, key, 1), F.lit("")))
    f = folders.where(F.col(folder).endswith(suffix)).select(folder, F.regexp_extract(folder, key, 1).alias("_key"))
    met = s.join(f, "_key", "left").groupBy(sample).agg(F.count(folder).alias("_n"), F.min(folder).alias(folder))
    problem = F.when(F.col("_n") == 0, "not found").when(F.col("_n") > 1, "ambiguous")
    return met.select(sample, F.when(F.col("_n") == 1, F.col(folder)).alias(folder), problem.alias("problem"))


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, values map) of key=value text files; section lines and blank lines are passed over."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("line")).where(F.col("line").contains("=") & ~F.col("line").startswith("["))
    kv = lines.select("path", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("v"))
    return kv.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


DETECTIONS = "fov_id int, n_spots_detected long, n_spots_filtered long, n_positives long"
SPOTS = "sample_id string, fov_id int, x double, y double, log_radius double, score double, positive int"


def detection_counts(spark: SparkSession, path: str, metric: str = "n_spots_detected", with_path: bool = False) -> DataFrame:
    """(fov_id, n_detected) of detection summaries, with the path of each row's file if asked."""
    own = [F.input_file_name().alias("path")] if with_path else []
    return spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema=DETECTIONS, enforceSchema=False).select(*own, "fov_id", F.col(metric).alias("n_detected"))


def spot_counts(spark: SparkSession, path: str, positives: bool = False) -> DataFrame:
    """(fov_id, n_detected) of a spot table: spots of each field, or their positives."""
    s = spark.read.csv(path, header=True, schema=SPOTS, enforceSchema=False)
    return s.groupBy("fov_id").agg((F.sum("positive") if positives else F.count(F.lit(1))).cast("long").alias("n_detected"))


def counts_with_source(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(slide_id, fov_id, n_detected, source): each slide's fields from the first source that has the slide."""
    return relational.first_source(parts, "slide_id")


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and lines of # remarks."""
    return spark.read.csv(path, header=True, schema=schema, comment="#")


def flag(value: Column) -> Column:
    """Text True, in any case, is true."""
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def number(value: Column) -> Column:
    """A double, null for blank or unreadable text."""
    return F.expr(f"try_cast(`{value}` as double)") if isinstance(value, str) else value.try_cast("double")


def slide_index(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, box, dpc_fov_ids, fluorescent_fov_ids) of a JSON index keyed by slide."""
    entry = T.StructType([T.StructField("box", T.StringType()), T.StructField("dpc_fov_ids", T.ArrayType(T.IntegerType())), T.StructField("fluorescent_fov_ids", T.ArrayType(T.IntegerType()))])
    raw = spark.read.json(path, multiLine=True, schema=T.StructType([T.StructField("slides", T.MapType(T.StringType(), entry))]))
    return raw.select(F.explode("slides").alias("slide_id", "e")).select("slide_id", "e.*")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def sheet_rows(content: bytes, sheet: str) -> list[tuple[int, dict[str, str]]]:
    """(row number, {column letters: text}) of a worksheet; blank cells are absent, phonetic readings left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        load = lambda name: ElementTree.fromstring(z.read(name))
        targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels").iterfind("p:Relationship", _NS)}
        found = next((s for s in load("xl/workbook.xml").iterfind(".//m:sheet", _NS) if s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet named {sheet}")
        target = targets[found.get(f"{{{_NS['r']}}}id")]
        text_of = lambda e: "".join(t.text or "" for t in [*e.findall("m:t", _NS), *e.findall("m:r/m:t", _NS)])
        shared = [text_of(s) for s in load("xl/sharedStrings.xml").iterfind("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in load(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iterfind(".//m:row", _NS):
            cells = {}
            for c in row.iterfind("m:c", _NS):
                v, kind = c.find("m:v", _NS), c.get("t")
                value = text_of(c.find("m:is", _NS)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                if value:
                    cells[re.match("[A-Z]+", c.get("r"))[0]] = value
            rows.append((int(row.get("r")), cells))
        return rows


def workbook(spark: SparkSession, path: str, sheet: str, header: str, columns: dict[str, str]) -> DataFrame:
    """Rows of a worksheet below the row in which some cell reads ``header``; ``columns``: letters to names. With row, the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = sheet_rows(content.as_py(), sheet)
                top = next((n for n, cells in rows if header in cells.values()), None)
                if top is None:
                    raise ValueError(f"no header {header!r} on sheet {sheet}")
                below = [(n, c) for n, c in rows if n > top and c]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in below], pa.int32()), *(pa.array([c.get(k) for _, c in below], pa.string()) for k in columns)], names=["row", *columns.values()])

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInArrow(run, "row int, " + ", ".join(f"`{c}` string" for c in columns.values()))


# How workable a slide is, worst to best.
RANKS = {"hard": 1, "can spot annotate": 2, "annotatable (hard)": 3, "annotatable": 4}


def catalog(rows: DataFrame, slide: str = "slide_id", quality: str = "quality", ranks: dict[str, int] = RANKS) -> DataFrame:
    """The first row of each slide with cleaned text, a hazard mark and the quality's rank (null where unknown)."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(slide).orderBy("row"))).where("_k = 1").drop("_k")
    q = F.lower(text.clean(F.col(quality)))
    pairs = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return first.withColumn("warned", F.coalesce(F.col(quality).contains("⚠"), F.lit(False))).withColumn(quality, q).withColumn("rank", F.try_element_at(pairs, F.coalesce(F.trim(F.regexp_replace(q, "[⚠️]", "")), F.lit(""))))


def merge_labels(parts: Sequence[tuple[str, DataFrame]], defaults: dict[str, str]) -> DataFrame:
    """All label tables as one, with their dataset; blank labels take the default."""
    out = None
    for name, df in parts:
        filled = df.withColumn("dataset", F.lit(name))
        for c, v in defaults.items():
            filled = filled.withColumn(c, F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit(v)) if c in df.columns else F.lit(v))
        out = filled if out is None else out.unionByName(filled, allowMissingColumns=True)
    return out
