"""Line images to network inputs, and network outputs to text by greedy CTC."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.operators.raster import GeometryError, planes_of, resize


def charset(entries: Sequence[str]) -> list[str]:
    """Class -> text; class 0 is the blank."""
    return ["", *entries]


def preprocess(bgr: np.ndarray, height: int = 48, width: int = 320) -> np.ndarray:
    """[1, 3, height, W] in -1 to 1, zero on the right of narrow lines."""
    h, w = bgr.shape[:2]
    if height <= 0 or width <= 0 or not h or not w:
        raise GeometryError(f"image {w} x {h} to {width} x {height}")
    ratio = w / h
    target = int(height * max(width / height, ratio))
    own = max(1, min(int(np.ceil(height * ratio)), target))
    out = np.zeros((1, 3, height, target), np.float32)
    out[0, :, :, :own] = resize(planes_of(bgr), own, height) * 2 - 1
    return out


def decode(output: np.ndarray, classes: Sequence[str]) -> list[tuple[str, float]]:
    """Text and mean probability of the emitted steps for each of [N, T, C]; the lowest class wins ties."""
    if output.ndim != 3 or output.shape[2] != len(classes):
        raise GeometryError(f"output {output.shape} for {len(classes)} classes")
    best = output.argmax(axis=2)
    emitted = np.ones(best.shape, bool)
    emitted[:, 1:] = best[:, 1:] != best[:, :-1]
    emitted &= best != 0
    top = output.max(axis=2)
    return [("".join(classes[k] for k in b[e]), float(np.float32(t[e].mean())) if e.any() else 0.0) for b, e, t in zip(best, emitted, top, strict=True)]


def decode_frame(steps: DataFrame, classes: DataFrame, key: str = "n") -> DataFrame:
    """key, text, confidence from steps(key, t, c, p) and classes(c, text): the same rule as aggregates and one window."""
    best = steps.groupBy(key, "t").agg(F.max_by(F.struct("c", "p"), F.struct("p", -F.col("c"))).alias("b")).select(key, "t", "b.c", "b.p")
    before = F.lag("c").over(Window.partitionBy(key).orderBy("t"))
    emitted = best.withColumn("before", before).where((F.col("c") != 0) & (F.col("before").isNull() | (F.col("c") != F.col("before"))))
    letters = emitted.join(classes, "c")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda x: x["text"]), "")
    read = letters.groupBy(key).agg(text.alias("text"), F.avg("p").cast("float").alias("confidence"))
    return steps.select(key).distinct().join(read, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0).cast("float")).alias("confidence"))
