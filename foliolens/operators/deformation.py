"""How bent a line of text is, and the level of treatment that follows."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from foliolens.operators.raster import GeometryError, fit_polynomial, polynomial, rectify_curve

CURVE_DEGREE = 2
UPRIGHT, TILTED, CURVED, UNREADABLE = range(4)


@dataclass(frozen=True)
class Thresholds:
    straight_px: float = 1.5
    curved_px: float = 1.5
    angle: float = np.pi / 180

    def relaxed(self, height: float, factor: float) -> Thresholds:
        """Pixel thresholds of at least a share of the line's height."""
        return replace(self, straight_px=max(self.straight_px, height * factor), curved_px=max(self.curved_px, height * factor))


def baseline(line: np.ndarray) -> np.ndarray:
    """The lower edge from left to right, without end points that both edges share."""
    n = len(line)
    if n < 4 or n % 2:
        raise GeometryError(f"a line polygon has an even number of vertices, not {n}")
    half = n // 2
    lower = line[half:][::-1]
    shared = (line[half - 1] == line[half]).all() and (line[n - 1] == line[0]).all()
    return lower[1:-1] if half >= 4 and shared else lower


def measure(points: np.ndarray) -> tuple[float, float, float]:
    """Angle, largest distance from the fitted line, and from the fitted parabola where one can be fitted."""
    if len(points) < 2:
        raise GeometryError("two points are needed")
    line = fit_polynomial(points, 1)
    linear = float(np.abs(points[:, 1] - polynomial(line, points[:, 0])).max())
    try:
        curve = float(np.abs(points[:, 1] - polynomial(fit_polynomial(points, CURVE_DEGREE), points[:, 0])).max())
    except GeometryError:
        curve = linear
    return float(np.arctan(line[1])), linear, curve


def classify(shape: tuple[float, float, float], limits: Thresholds = Thresholds()) -> int:
    angle, linear, curve = shape
    if curve > limits.curved_px:
        return UNREADABLE
    if linear > limits.straight_px:
        return CURVED
    return TILTED if abs(angle) > limits.angle else UPRIGHT


def page_level(shapes: list[tuple[float, float, float]], limits: Thresholds = Thresholds()) -> int:
    return max((classify(s, limits) for s in shapes), default=UPRIGHT)


def rectify_line(plane: np.ndarray, points: np.ndarray, width: int, height: int, above: float, below: float) -> np.ndarray:
    """The band along the baseline's fitted curve."""
    if len(points) < 2:
        raise GeometryError("two points are needed")
    curve = fit_polynomial(points, min(CURVE_DEGREE, len(points) - 1))
    return rectify_curve(plane, curve, float(points[:, 0].min()), float(points[:, 0].max()), width, height, above, below)
