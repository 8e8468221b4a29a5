"""Images as NumPy arrays: planes are float32 [H, W] in 0 to 1, colour images uint8 [H, W, 3] in the order B, G, R.

Sampling takes several planes at once, [..., H, W], and planes of bytes, of which only the sampled ones become floats."""

from __future__ import annotations

import numpy as np

F32 = np.float32
LUMINANCE = (0.299, 0.587, 0.114)  #: fixed values: weights of R, G, B


class GeometryError(ValueError):
    pass


def luminance(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    return ((LUMINANCE[0] * r + LUMINANCE[1] * g + LUMINANCE[2] * b) / 255).astype(F32)


def channel(bgr: np.ndarray, index: int) -> np.ndarray:
    return bgr[..., index].astype(F32) / F32(255)


def to_bytes(plane: np.ndarray) -> np.ndarray:
    return (np.clip(plane, 0, 1) * F32(255) + F32(0.5)).astype(np.uint8)


def compose(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    if not b.shape == g.shape == r.shape:
        raise GeometryError("planes differ in size")
    return np.stack([to_bytes(p) for p in (b, g, r)], axis=-1)


def planes_of(bgr: np.ndarray) -> np.ndarray:
    """[3, H, W], a view."""
    return np.moveaxis(bgr, -1, 0)


def _unit(values: np.ndarray) -> np.ndarray:
    """Bytes as floats, plane by plane in memory: views of colour images are slow to gather from. Floats as they are."""
    if values.dtype != np.uint8:
        return values
    out = values.astype(F32, order="C")
    out /= F32(255)
    return out


def _between(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pixels on both sides of coordinates, moved to the border, and the share of the second."""
    at = np.clip(at, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), (at - low).astype(F32)


def sample(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; coordinates beyond the border are moved to it. Only the box that holds them is read."""
    h, w = plane.shape[-2:]
    x, y = np.broadcast_arrays(x, y)
    if not x.size:
        return np.zeros((*plane.shape[:-2], *x.shape), F32)
    (x0, x1, fx), (y0, y1, fy) = _between(x, w), _between(y, h)
    left, top = x0.min(), y0.min()
    if left < 0 or top < 0:
        raise GeometryError("a coordinate is not a number")
    own = _unit(plane[..., top : y1.max() + 1, left : x1.max() + 1])
    if x.ndim == 2 and all((v == v[:1]).all() for v in (x0, fx)) and all((v == v[:, :1]).all() for v in (y0, fy)):
        # An upright grid: along x once for each row that is read, then along y.
        at, f, down = x0[0] - left, fx[0], fy[:, :1]
        along = own[..., at] * (1 - f) + own[..., x1[0] - left] * f
        return (along[..., y0[:, 0] - top, :] * (1 - down) + along[..., y1[:, 0] - top, :] * down).astype(F32)
    wide, flat = own.shape[-1], own.reshape(*own.shape[:-2], -1)
    at, right, below = (y0 - top) * wide + (x0 - left), x1 - x0, (y1 - y0) * wide
    upper = flat.take(at, axis=-1) * (1 - fx) + flat.take(at + right, axis=-1) * fx
    at += below
    return (upper * (1 - fy) + (flat.take(at, axis=-1) * (1 - fx) + flat.take(at + right, axis=-1) * fx) * fy).astype(F32)


def resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with aligned pixel centres, without smoothing; along x and then y, an axis of the same size as it is. The result is a new array."""
    h, w = plane.shape[-2:]
    own = _unit(plane)
    if width != w:
        low, high, f = _between((np.arange(width) + 0.5) * w / width - 0.5, w)
        own = own[..., low] * (1 - f) + own[..., high] * f
    if height != h:
        low, high, f = _between((np.arange(height) + 0.5) * h / height - 0.5, h)
        own = own[..., low, :] * (1 - f[:, None]) + own[..., high, :] * f[:, None]
    return own.astype(F32, order="C", copy=own is plane)


def integral(plane: np.ndarray) -> np.ndarray:
    """Summed-area table with a zero border, in float64."""
    return np.pad(plane.astype(np.float64), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)


def box_sum(table: np.ndarray, x0, y0, x1, y1):
    """Sum over x0 <= x < x1, y0 <= y < y1."""
    return table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]


def box_blur(plane: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the part of a square window that lies in the image."""
    if radius <= 0:
        return plane.copy()
    h, w = plane.shape
    y, x = np.mgrid[0:h, 0:w]
    x0, y0, x1, y1 = np.maximum(x - radius, 0), np.maximum(y - radius, 0), np.minimum(x + radius + 1, w), np.minimum(y + radius + 1, h)
    return (box_sum(integral(plane), x0, y0, x1, y1) / ((x1 - x0) * (y1 - y0))).astype(F32)


def even_illumination(plane: np.ndarray, radius: int, epsilon: float = 1e-3) -> np.ndarray:
    """The plane over its blur."""
    return (plane / (box_blur(plane, radius) + F32(epsilon if epsilon > 0 else 1e-3))).astype(F32)


# ---- fits and maps

def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination with partial pivoting; a pivot under 1e-12 is an error."""
    m = np.column_stack([np.asarray(a, float), np.asarray(b, float)])
    n = len(m)
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[p, k]) < 1e-12:
            raise GeometryError("singular system")
        m[[k, p]] = m[[p, k]]
        m[k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k])
    x = np.zeros(n)
    for k in reversed(range(n)):
        x[k] = (m[k, n] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x


def fit_polynomial(points: np.ndarray, degree: int) -> np.ndarray:
    """Ascending least-squares coefficients by the normal equations."""
    if degree < 0 or len(points) < degree + 1:
        raise GeometryError(f"{len(points)} points for degree {degree}")
    powers = np.vander(points[:, 0], degree + 1, increasing=True)
    return solve(powers.T @ powers, powers.T @ points[:, 1])


def polynomial(coefficients: np.ndarray, x):
    return sum(c * np.asarray(x, float) ** i for i, c in enumerate(coefficients))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 projective map that takes four points to four others; its last value is 1."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def project(h: np.ndarray, x, y):
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w


def rectify_quad(plane: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral as a rectangle; its corners become the centres of the corner pixels."""
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    return sample(plane, *project(homography(target, np.asarray(corners, float)), x, y))


ARC_SAMPLES = 512


def arc_lengths(coefficients: np.ndarray, x_min: float, x_max: float, n: int = ARC_SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Places and the arc length up to them, by the trapezoid rule."""
    slope = np.polynomial.polynomial.polyder(coefficients) if len(coefficients) > 1 else np.zeros(1)
    x = np.linspace(x_min, x_max, n)
    speed = np.hypot(1, polynomial(slope, x))
    return x, np.append(0, np.cumsum((speed[1:] + speed[:-1]) / 2 * np.diff(x)))


def rectify_curve(plane: np.ndarray, coefficients: np.ndarray, x_min: float, x_max: float, width: int, height: int, above: float, below: float) -> np.ndarray:
    """The band along a curve, straightened: columns at equal arc lengths, rows along the normals."""
    if x_max <= x_min or width <= 0 or height <= 0:
        raise GeometryError(f"range {x_min} to {x_max}, size {width} x {height}")
    places, lengths = arc_lengths(coefficients, x_min, x_max)
    x = np.interp((np.arange(width) + 0.5) / width * lengths[-1], lengths, places)
    slope = polynomial(np.polynomial.polynomial.polyder(coefficients), x) if len(coefficients) > 1 else np.zeros(width)
    norm = np.hypot(1, slope)
    offset = np.linspace(-above, below, height)[:, None] if height > 1 else np.array([[-above]])
    return sample(plane, x - slope / norm * offset, polynomial(coefficients, x) + offset / norm)


def by_channel(bgr: np.ndarray, rectify) -> np.ndarray:
    """A colour crop from a function that rectifies planes; places are computed once for all channels."""
    return np.moveaxis(to_bytes(rectify(planes_of(bgr))), 0, -1)
