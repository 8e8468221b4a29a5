"""Page images to regions, words, lines and levels.

Everything that needs pixels happens in one Arrow-batched pass over pages: pixels cross the border between JVM and Python
once, and only regions come back. A region that cannot be measured or read never fails its page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.operators import deformation as W
from foliolens.operators import detection as D
from foliolens.operators import recognition as R
from foliolens.operators.layout import read_lines
from foliolens.operators.raster import GeometryError, by_channel, rectify_quad
from foliolens.plans.graph import Plan, plan
from foliolens.sources.onnx import ModelError, load
from foliolens.sources.pages import Identity, ScanOptions, apply_filter, identity_of, parse_filter, read_dictionary

N2_BELOW = 0.15  #: fixed value: the part of a curved line's height that is read below its baseline
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_FIELDS = [
    ("page_id", pa.string()), ("region_no", pa.int32()), ("polygon", pa.list_(_POINT)), ("score", pa.float32()), ("level", pa.int32()), ("measured", pa.bool_()), ("angle", pa.float64()), ("linear_bow", pa.float64()), ("curve_bow", pa.float64()),
    ("text", pa.string()), ("ctc_confidence", pa.float32()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()),
]
REGIONS = "page_id string, region_no int, polygon array<struct<x: double, y: double>>, score float, level int, measured boolean, angle double, linear_bow double, curve_bow double, text string, ctc_confidence float, x0 double, y0 double, x1 double, y1 double"


def positive_size(v: float) -> int:
    """Rounded, halves away from zero, 1 at least."""
    return max(1, int(np.floor(v + 0.5)))


@dataclass(frozen=True)
class Measured:
    line: np.ndarray
    shape: tuple[float, float, float]
    level: int
    low: np.ndarray
    high: np.ndarray

    @property
    def size(self) -> tuple[int, int]:
        return positive_size(self.high[0] - self.low[0]), positive_size(self.high[1] - self.low[1])


def measure_region(polygon: np.ndarray, sx: float, sy: float, options: ScanOptions) -> Measured | None:
    """The line of a region in page pixels, its shape, and its level under thresholds relaxed by its height."""
    try:
        line = D.rescale(D.line_polygon(polygon, options.points_per_edge), sx, sy)
        shape = W.measure(W.baseline(line))
    except GeometryError:
        return None
    low, high = line.min(axis=0), line.max(axis=0)
    return Measured(line, shape, W.classify(shape, options.thresholds.relaxed(high[1] - low[1], options.relative_deformation)), low, high)


def crop(page: np.ndarray, m: Measured) -> np.ndarray | None:
    """The region as an upright image: its bounding box, or the band along its baseline; none for the last level."""
    width, height = m.size
    try:
        if m.level in (W.UPRIGHT, W.TILTED):
            corners = np.array([m.low, [m.high[0], m.low[1]], m.high, [m.low[0], m.high[1]]])
            return by_channel(page, lambda plane: rectify_quad(plane, corners, width, height))
        if m.level == W.CURVED:
            above = float(m.high[1] - m.low[1])
            points = W.baseline(m.line)
            return by_channel(page, lambda plane: W.rectify_line(plane, points, width, positive_size(above * (1 + N2_BELOW)), above, above * N2_BELOW))
    except GeometryError:
        pass
    return None


def read_region(page: np.ndarray, m: Measured, recogniser: Plan, classes: list[str], options: ScanOptions) -> tuple[str, float] | None:
    image = crop(page, m)
    if image is None:
        return None
    try:
        given = R.preprocess(image, options.line_height, options.line_width)
        return R.decode(recogniser.run(**{recogniser.inputs[0]: given})[recogniser.outputs[0]], classes)[0]
    except (GeometryError, ModelError, IndexError):
        return None


def scan_page(page: np.ndarray, detector: Plan, recogniser: Plan | None, classes: list[str], options: ScanOptions) -> list[dict]:
    """The regions of a page [H, W, 3] of BGR bytes, read where possible."""
    given, sx, sy = D.preprocess(page, options.side_limit)
    output = detector.run(**{detector.inputs[0]: given})[detector.outputs[0]]
    if output.ndim != 4:
        raise ModelError(f"detector output {output.shape}")
    return process_regions(page, D.detect(output[0, 0], options.detector), sx, sy, recogniser, classes, options)


def process_regions(page: np.ndarray, regions: list[tuple[np.ndarray, float]], sx: float, sy: float, recogniser: Plan | None, classes: list[str], options: ScanOptions) -> list[dict]:
    """The rows of regions, polygons as arrays; without a recogniser they are measured but not read."""
    out = []
    for i, (polygon, score) in enumerate(regions):
        row = dict.fromkeys(n for n, _ in _FIELDS) | {"region_no": i, "score": score, "level": 0, "measured": False, "text": "", "ctc_confidence": 0.0}
        row["polygon"] = D.rescale(polygon, sx, sy)
        if (m := measure_region(polygon, sx, sy, options)) is not None:
            row |= {"level": m.level, "measured": True, **dict(zip(("angle", "linear_bow", "curve_bow"), m.shape, strict=True)), **dict(zip(("x0", "y0", "x1", "y1"), (*m.low.tolist(), *m.high.tolist()), strict=True))}
            if recogniser is not None and (read := read_region(page, m, recogniser, classes, options)) and read[0]:
                row |= {"text": read[0], "ctc_confidence": read[1]}
        out.append(row)
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows of regions; the many points of their polygons never become Python objects."""
    polygons = [r["polygon"] for r in rows]
    points = pa.StructArray.from_arrays([pa.array(axis) for axis in np.concatenate(polygons).T], fields=list(_POINT))
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, polygons)]), pa.int32()), points)
    columns = [listed if name == "polygon" else pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS))


#: Pages of one Arrow batch. Their pixels take room in the JVM and in the worker, and larger batches cross more slowly.
PAGES_A_BATCH = 16


def _in_small_batches(pages: DataFrame) -> DataFrame:
    """pages in a copy of its session, with all its settings but the rows of an Arrow batch; the session itself stays as it is."""
    spark = pages.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_A_BATCH))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, pages._jdf.logicalPlan()), SparkSession(spark.sparkContext, own))


class Engine:
    """A detector, a recogniser and a dictionary; scans DataFrames of pages."""

    def __init__(self, detector: Plan, recogniser: Plan, entries: list[str], options: ScanOptions | None = None, det_hash: str = "", rec_hash: str = ""):
        for role, p in (("detector", detector), ("recogniser", recogniser)):
            if len(p.inputs) != 1 or len(p.outputs) != 1:
                raise ModelError(f"the {role} needs one input and one output")
        self.detector, self.recogniser, self.classes = detector, recogniser, R.charset(entries)
        self.options = options or ScanOptions()
        self.identity: Identity = identity_of(self.options, det_hash, rec_hash)

    @classmethod
    def open(cls, detector_path: str, recogniser_path: str, dictionary_path: str, options: ScanOptions | None = None, filter_json: str | bytes | None = None) -> Engine:
        (det, det_hash), (rec, rec_hash) = load(detector_path), load(recogniser_path)
        own = options or ScanOptions()
        if filter_json:
            own = apply_filter(own, parse_filter(filter_json))
        return cls(plan(det), plan(rec), read_dictionary(dictionary_path), own, det_hash, rec_hash)

    def regions(self, pages: DataFrame, read: bool = True) -> DataFrame:
        """The regions of pages(page_id, width, height, image). Where no texts are wanted, ``read`` saves reading them: all
        else stays the same, and texts are empty."""
        held = pages.sparkSession.sparkContext.broadcast((self.detector, self.recogniser if read else None, self.classes, self.options))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for page_id, w, h, data in zip(*(b.column(c).to_pylist() for c in ("page_id", "width", "height")), b.column("image"), strict=True):
                    page = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, 3)
                    rows += [r | {"page_id": page_id} for r in scan_page(page, *held.value)]
                if rows:
                    yield _batch(rows)

        return _in_small_batches(pages).select(F.col("page_id").cast("string").alias("page_id"), "width", "height", "image").mapInArrow(scan, REGIONS)

    def page_levels(self, regions: DataFrame) -> DataFrame:
        """page_id, page_level: the highest level of its measured regions under the absolute thresholds."""
        t = self.options.thresholds
        level = F.when(F.col("curve_bow") > t.curved_px, 3).when(F.col("linear_bow") > t.straight_px, 2).when(F.abs("angle") > t.angle, 1).otherwise(0)
        return regions.groupBy("page_id").agg(F.coalesce(F.max(F.when(F.col("measured"), level)), F.lit(0)).alias("page_level"))


def words_of(regions: DataFrame) -> DataFrame:
    """words of regions that were read."""
    return regions.where("text <> ''").select("page_id", F.col("region_no").alias("word_no"), "x0", "y0", "x1", "y1", "text", F.col("ctc_confidence").alias("confidence"))


def lines_of_pages(regions: DataFrame) -> DataFrame:
    return read_lines(words_of(regions))
