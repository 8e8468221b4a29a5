"""Page images, dictionaries, filters, and the identity of an engine."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.operators.detection import DetectOptions
from foliolens.operators.deformation import Thresholds
from foliolens.operators.layout import OVERLAP

ENGINE_VERSION, CONTRACT_VERSION = "foliolens-0.1.0", "a0"


@dataclass(frozen=True)
class ScanOptions:
    detector: DetectOptions = field(default_factory=DetectOptions)
    thresholds: Thresholds = field(default_factory=Thresholds)
    side_limit: float = 960
    line_height: int = 48
    line_width: int = 320
    points_per_edge: int = 8
    relative_deformation: float = 0.3


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (the origin), width, height, image (BGR bytes) of PNG and JPEG files; decoded by the executors' JVM."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    colour = images.where(F.col("image.nChannels") == 3)
    return colour.select(F.col("image.origin").alias("page_id"), "image.width", "image.height", F.col("image.data").alias("image"))


def read_dictionary(path: str) -> list[str]:
    """Entries of a dictionary file, one a line. Only line ends are stripped: an entry may be a space."""
    with open(path, encoding="utf-8", newline="") as f:
        entries = [x.rstrip("\r\n") for x in f]
    entries = [x for x in entries if x]
    if not entries:
        raise ValueError(f"{path} has no entries")
    return entries


#: Filter keys -> option names.
_DETECT = {"Threshold": "threshold", "MinArea": "min_area", "MinScore": "min_score", "UnclipRatio": "unclip_ratio"}
_DEWARP = {"RetoPx": "straight_px", "CurvoPx": "curved_px", "AnguloRad": "angle"}
_TOP = ("versao", "motor_versao", "onnx_det_uri", "onnx_rec_uri", "detect", "dewarp", "layout", "contrato_versao")


def _section(given: dict, names: dict[str, str], kind: type):
    """A section replaces the whole: keys that it lacks are zero. Keys match without regard to case."""
    by_name = {k.lower(): v for k, v in names.items()}
    if unknown := [k for k in given if k.lower() not in by_name]:
        warnings.warn(f"filter keys that are not known: {unknown}", stacklevel=3)
    return kind(**dict.fromkeys(names.values(), 0.0) | {by_name[k.lower()]: float(v) for k, v in given.items() if k.lower() in by_name})


def parse_filter(text: str | bytes) -> dict:
    """A filter: option sections and versions. An absent section is all zeros."""
    given = json.loads(text)
    if unknown := [k for k in given if k not in _TOP]:
        warnings.warn(f"filter keys that are not known: {unknown}", stacklevel=2)
    out = {k: given.get(k, "") for k in _TOP if k not in ("detect", "dewarp", "layout")}
    return out | {"detect": _section(given.get("detect", {}), _DETECT, DetectOptions), "dewarp": _section(given.get("dewarp", {}), _DEWARP, Thresholds), "overlap_fraction": given.get("layout", {}).get("overlap_fraction", 0.0)}


def apply_filter(options: ScanOptions, parsed: dict) -> ScanOptions:
    return replace(options, detector=parsed["detect"], thresholds=parsed["dewarp"])


@dataclass(frozen=True)
class Identity:
    """What decides an engine's results."""

    motor_versao: str
    det_hash: str
    rec_hash: str
    detect: DetectOptions
    dewarp: Thresholds
    overlap: float
    contrato_versao: str

    def columns(self) -> dict:
        """The identity as literal columns, to keep with results."""
        flat = {"motor_versao": self.motor_versao, "det_hash": self.det_hash, "rec_hash": self.rec_hash, "overlap": self.overlap, "contrato_versao": self.contrato_versao, **asdict(self.detect), **asdict(self.dewarp)}
        return {k: F.lit(v) for k, v in flat.items()}


def identity_of(options: ScanOptions, det_hash: str, rec_hash: str) -> Identity:
    return Identity(ENGINE_VERSION, det_hash, rec_hash, options.detector, options.thresholds, OVERLAP, CONTRACT_VERSION)
