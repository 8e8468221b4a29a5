"""Tables of planes, as tensors(key, shape [H, W], data), in single Arrow passes: planes to planes, to contours, to regions, and to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.operators import deformation as W
from foliolens.operators import detection as D
from foliolens.operators import recognition as R
from foliolens.operators.raster import GeometryError

POLYGON = "array<struct<x: double, y: double>>"
_POLYGON = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _points(polygon: np.ndarray | None) -> list[dict] | None:
    return None if polygon is None else [{"x": x, "y": y} for x, y in polygon.tolist()]


def arrays(batch: pa.RecordBatch, key: str) -> Iterator[tuple[Any, np.ndarray]]:
    """Keys and arrays of a batch, without a copy of the data."""
    column = batch.column("data")
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for k, shape, low, high in zip(batch.column(key).to_pylist(), batch.column("shape").to_pylist(), ends[:-1], ends[1:], strict=True):
        yield k, values[low:high].reshape(shape)


def _pass(tensors: DataFrame, key: str, rows_of: Callable[[np.ndarray], list[dict]], fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """The rows of every plane, with its key; a batch of rows for each batch of planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{key: k} | r for k, plane in arrays(b, key) for r in rows_of(plane)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(key, b.schema.field(key).type), *fields]))

    return tensors.select(key, "shape", "data").mapInArrow(run, f"{key} {tensors.schema[key].dataType.simpleString()}, {schema}")


def map_planes(tensors: DataFrame, change: Callable[[np.ndarray], np.ndarray], key: str = "id") -> DataFrame:
    """key, shape, data: a function of every array."""

    def rows(plane: np.ndarray) -> list[dict]:
        out = change(plane)
        return [{"shape": list(out.shape), "data": out.reshape(-1)}]

    return _pass(tensors, key, rows, [("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))], "shape array<int>, data array<float>")


def contours_of(tensors: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """key, region_no, polygon: the outer contours of what reaches the threshold."""

    def rows(plane: np.ndarray) -> list[dict]:
        return [{"region_no": i, "polygon": _points(p)} for i, p in enumerate(D.contours(plane >= np.float32(threshold)))]

    return _pass(tensors, key, rows, [("region_no", pa.int32()), ("polygon", _POLYGON)], f"region_no int, polygon {POLYGON}")


def _measured(polygon: np.ndarray, points: int) -> dict:
    """A line polygon and its shape; nulls for what cannot be measured."""
    try:
        line = D.line_polygon(polygon, points)
        return {"line": _points(line), **dict(zip(("angle", "linear_bow", "curve_bow"), W.measure(W.baseline(line)), strict=True))}
    except GeometryError:
        return {}


def regions_of(tensors: DataFrame, options: D.DetectOptions | None = None, key: str = "id", points: int = 8) -> DataFrame:
    """key, region_no, polygon, score, line, angle, linear_bow, curve_bow of the regions of probability maps."""
    own = options or D.DetectOptions()

    def rows(plane: np.ndarray) -> list[dict]:
        return [{"region_no": i, "polygon": _points(p), "score": s, **_measured(p, points)} for i, (p, s) in enumerate(D.detect(plane, own))]

    shape = [(n, pa.float64()) for n in ("angle", "linear_bow", "curve_bow")]
    return _pass(tensors, key, rows, [("region_no", pa.int32()), ("polygon", _POLYGON), ("score", pa.float32()), ("line", _POLYGON), *shape], f"region_no int, polygon {POLYGON}, score float, line {POLYGON}, angle double, linear_bow double, curve_bow double")


def texts_of(tensors: DataFrame, classes: Sequence[str], key: str = "id") -> DataFrame:
    """key, text, confidence of recogniser outputs [T, C]."""

    def rows(output: np.ndarray) -> list[dict]:
        (text, confidence), = R.decode(output[None], classes)
        return [{"text": text, "confidence": confidence}]

    return _pass(tensors, key, rows, [("text", pa.string()), ("confidence", pa.float32())], "text string, confidence float")
