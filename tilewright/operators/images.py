"""Image kernels over tables of encoded images: a struct of signals per image, never pixels; failures are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..kernels import images as kernels

FIELD = ("coverage", "otsu_threshold", "otsu_separability", "saturation_score", "lbp_entropy", "glcm_contrast", "edge_density_unmasked", "tile_glcm_cv", "tile_glcm_patchiness")
FOCUS = tuple(f"{r}__{m}" for r in ("whole", "tl", "tr", "bl", "br") for m in kernels.FOCUS) + tuple(f"{m}__quadrant_range" for m in kernels.FOCUS)
HALO = ("contrast_ratio", "baseline", "peak", "area_fraction", "solidity", "anisotropy", "radial_rho", "r2_over_r1", "diffuse_radius", "diffuse_circularity", "diffuse_centroid_x", "diffuse_centroid_y")


#: Pixels up to which images of one shape are worked on side by side, and rows up to which they are sent on together.
TOGETHER, ROWS = 1 << 18, 1 << 10


def _each(items: Iterable[pa.Scalar], decode: Callable, kernel: Callable, many: Callable | None) -> Iterator[tuple]:
    """(result, null) or (null, error) of each image in turn, by ``many`` for stacks of images of one shape, by ``kernel`` for the others."""
    why = lambda e: f"{type(e).__name__}: {e}"[:200]

    def alone(image: np.ndarray) -> tuple:
        try:
            return kernel(image), None
        except Exception as e:  # an image that cannot be read is a row, not a failed task
            return None, why(e)

    def results(held: list[np.ndarray]) -> list[tuple]:
        if len(held) > 1:
            try:
                return [(r, None) for r in many(np.stack(held))]
            except Exception:  # which image it was shows when each is taken alone
                pass
        return [alone(x) for x in held]

    held: list[np.ndarray] = []
    for item in items:
        try:
            image, error = decode(item.as_py()), None
        except Exception as e:
            image, error = None, why(e)
        if held and (image is None or many is None or (image.shape, image.dtype) != (held[0].shape, held[0].dtype) or (len(held) + 1) * image.size > TOGETHER):
            yield from results(held)
            held = []
        if image is None:
            yield None, error
        else:
            held.append(image)
    yield from results(held)


def signals(images: DataFrame, kernel: Callable[[np.ndarray], dict], names: tuple[str, ...], content: str = "content", decode: Callable = kernels.decode, many: Callable[[np.ndarray], list[dict]] | None = None) -> DataFrame:
    """All columns but the content, the named signals, and error: null, or why an image has none.

    Images are taken one by one within a batch, so memory is that of one image; with ``many``, the
    kernel for a stack of them, small images of one shape side by side.
    """
    keep = [c for c in images.columns if c != content]
    at = images.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for row, error in _each(batch.column(at), decode, kernel, many):
                rows.append({} if row is None else row)
                errors.append(error)
            cols = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array([r.get(n) for r in rows], pa.float64()) for n in names] + [pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names, "error"])

    schema = T.StructType([*(images.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("error", T.StringType())])
    return images.mapInArrow(run, schema)


def field_signals(images: DataFrame, lbp_step: int = 1, blur_shrink: int = 1, **how) -> DataFrame:
    return signals(images, lambda x: kernels.field_features(x, lbp_step, blur_shrink), FIELD, **how)


def focus_signals(images: DataFrame, **how) -> DataFrame:
    return signals(images, kernels.focus_features, FOCUS, **how)


def halo_signals(images: DataFrame, **how) -> DataFrame:
    return signals(images, kernels.halo_signals, HALO, **how)


def cells(images: DataFrame, content: str = "content", decode: Callable = kernels.decode, least: int = 30, kernel: Callable = kernels.outlines, many: Callable | None = None) -> DataFrame:
    """One image to many rows: a row per outline that ``kernel`` finds, with area, band power, solidity, centre; error is null.

    An image that cannot be read is one row without an outline, with the error. ``many`` is the kernel for a stack of images.
    """
    keep = [c for c in images.columns if c != content]
    at = images.columns.index(content)
    measures = ("area", "band_power", "solidity", "cy", "cx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(keep)

            def sent(of: list[int], rows: list[dict], errors: list[str | None], kept: pa.RecordBatch = kept) -> pa.RecordBatch:
                found = [pa.array([r.get("cell") for r in rows], pa.int64()), *(pa.array([r.get(n) for r in rows], pa.float64()) for n in measures)]
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in kept.columns), *found, pa.array(errors, pa.string())], names=names)

            of, rows, errors = [], [], []
            for i, (own, error) in enumerate(_each(batch.column(at), decode, lambda x: kernel(x, least), many and (lambda x: many(x, least)))):
                own = [{}] if own is None else own
                of += [i] * len(own)
                rows += own
                errors += [error] * len(own)
                if len(rows) >= ROWS:
                    yield sent(of, rows, errors)
                    of, rows, errors = [], [], []
            if rows:
                yield sent(of, rows, errors)

    names = [*keep, "cell", *measures, "error"]
    schema = T.StructType([*(images.schema[c] for c in keep), T.StructField("cell", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in measures), T.StructField("error", T.StringType())])
    return images.mapInArrow(run, schema)
