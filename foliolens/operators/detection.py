"""Text regions from a probability map: binarise, trace, score, grow; and the line polygons that measuring needs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliolens.operators.raster import GeometryError, planes_of, resize

#: Mean and deviation of the channels B, G, R.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MITER_LIMIT = 4.0


@dataclass(frozen=True)
class DetectOptions:
    threshold: float = 0.3
    min_area: float = 9.0
    min_score: float = 0.5
    unclip_ratio: float = 1.5


def multiple_of_32(v: int) -> int:
    """The nearest, halves to even, 32 at least."""
    return max(32, round(v / 32) * 32)


def resized(width: int, height: int, limit: float = 960) -> tuple[int, int]:
    ratio = limit / max(width, height) if max(width, height) > limit else 1.0
    return multiple_of_32(int(width * ratio)), multiple_of_32(int(height * ratio))


def preprocess(bgr: np.ndarray, limit: float = 960) -> tuple[np.ndarray, float, float]:
    """[1, 3, H, W] input and the scales of x and y."""
    h, w = bgr.shape[:2]
    if not h or not w:
        raise GeometryError("empty image")
    nw, nh = resized(w, h, limit)
    mean, deviation = (np.array(v, np.float32)[:, None, None] for v in (MEAN, DEVIATION))
    planes = resize(planes_of(bgr), nw, nh)
    planes -= mean
    planes /= deviation
    return planes[None], nw / w, nh / h


def rescale(polygon: np.ndarray, sx: float, sy: float) -> np.ndarray:
    return polygon / np.array([sx, sy])


def _runs(bitmap: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Row, start and end of each run of set pixels in a row, in raster order, and the number of its 8-connected component:
    from 1, by first pixels.

    Runs are joined with the runs they touch in the row above, by union-find over runs."""
    h, w = bitmap.shape
    wide = np.zeros((h, w + 2), bool)
    wide[:, 1:-1] = bitmap
    # Where a pixel differs from the one before it, a run starts or ends, in turn.
    rows, edges = np.divmod(np.flatnonzero(wide[:, 1:] != wide[:, :-1]), w + 1)
    first = np.searchsorted(rows[::2], np.arange(h + 1)).tolist()
    rows, starts, ends = rows[::2].tolist(), edges[::2].tolist(), edges[1::2].tolist()
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(1, h):
        above = first[y - 1]
        for i in range(first[y], first[y + 1]):
            while above < first[y] and ends[above] < starts[i]:
                above += 1
            k = above
            while k < first[y] and starts[k] <= ends[i]:
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
                k += 1
    numbers: dict[int, int] = {}
    return rows, starts, ends, [numbers.setdefault(find(i), len(numbers) + 1) for i in range(len(rows))]


def components(bitmap: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of 8-connected components, from 1 in raster order of their first pixels, and their number."""
    labels, count = np.zeros(bitmap.shape, int), 0
    for y, start, end, label in zip(*_runs(bitmap), strict=True):
        labels[y, start:end] = label
        count = max(count, label)
    return labels, count


#: Steps in x and y to the eight neighbours, clockwise from the west.
STEPS = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


#: The step to take, by the step back to where one came from and the set neighbours (a bit for each step); 8 if there are none.
TURNS = bytes(next((d for k in range(1, 9) if around >> (d := (came + k) % 8) & 1), 8) for came in range(8) for around in range(256))

SINGLE = [bytes([v]) for v in range(256)]


def neighbours(bitmap: np.ndarray) -> bytes:
    """A byte for each pixel, with a bit for each set neighbour."""
    h, w = bitmap.shape
    wide = np.zeros((h + 2, w + 2), np.uint8)
    wide[1:-1, 1:-1] = bitmap
    out = np.zeros((h, w), np.uint8)
    for d, (dx, dy) in enumerate(STEPS):
        out |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << np.uint8(d)
    return out.tobytes()


def trace(bitmap: np.ndarray, x: int, y: int, around: bytes | None = None) -> np.ndarray:
    """The outer contour from its first pixel, clockwise, up to the first return to it; an isolated pixel is one vertex.
    ``around`` saves finding the neighbours again."""
    width = bitmap.shape[1]
    around = neighbours(bitmap) if around is None else around
    jumps = [dx + dy * width for dx, dy in STEPS]
    start = here = y * width + x
    came, path = 0, [start]
    for _ in range(8 * bitmap.size + 8):
        own = around[here]
        turn = TURNS[came << 8 | own]
        if turn == 8:
            break
        if turn == came ^ 4 and turn & 3 == 0 and around[here + jumps[turn]] == own:
            # Straight on along a row up to the first pixel with other neighbours. The start, with none to its west, is not passed.
            row = here - here % width
            alike = around[here : row + width] if turn == 4 else around[row : here + 1]
            n = len(alike) - len(alike.lstrip(SINGLE[own]) if turn == 4 else alike.rstrip(SINGLE[own]))
            path += range(here + 1, here + n) if turn == 4 else range(here - 1, here - n, -1)
            here += jumps[turn] * n
        else:
            here += jumps[turn]
        came = turn ^ 4
        if here == start:
            break
        path.append(here)
    at = np.array(path)
    return np.stack([at % width, at // width], axis=1).astype(float)


def contours(bitmap: np.ndarray) -> list[np.ndarray]:
    """One outer contour for each component, in the order of labels. Only the box that holds them is looked at."""
    rows, columns = (np.flatnonzero(bitmap.any(axis=axis)) for axis in (1, 0))
    if not len(rows):
        return []
    left, top = columns[0], rows[0]
    own = bitmap[top : rows[-1] + 1, left : columns[-1] + 1]
    firsts: dict[int, tuple[int, int]] = {}
    for y, start, _, label in zip(*_runs(own), strict=True):
        firsts.setdefault(label, (start, y))
    around = neighbours(own)
    return [trace(own, x, y, around) + np.array([left, top]) for x, y in firsts.values()]


def _next(p: np.ndarray) -> np.ndarray:
    """The vertex after each; np.roll takes several times as long on so few."""
    return np.concatenate((p[1:], p[:1]))


def area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = _next(p)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def perimeter(p: np.ndarray) -> float:
    return float(np.hypot(*(_next(p) - p).T).sum()) if len(p) > 1 else 0.0


def centroid(p: np.ndarray) -> np.ndarray:
    if not len(p):
        return np.zeros(2)
    a = area(p)
    if len(p) < 3 or abs(a) < 1e-9:
        return p.mean(axis=0)
    q = _next(p)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return ((p + q) * c[:, None]).sum(axis=0) / (6 * a)


def inside(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for (ax, ay), (bx, by) in zip(p, _next(p), strict=True):
        if ay != by:
            out ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return out


def inside_box(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``inside`` for every pixel of a box, both corners included. An edge is only looked at in the rows that it crosses,
    where it flips all pixels to its left."""
    q = _next(p)
    height, width = int(high[1] - low[1] + 1), int(high[0] - low[0] + 1)
    first, stop = (np.clip(np.ceil(f(p[:, 1], q[:, 1])) - low[1], 0, height).astype(int) for f in (np.minimum, np.maximum))
    rows = stop - first
    edge = np.repeat(np.arange(len(p)), rows)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows) + first[edge]
    (ax, ay), (bx, by) = p[edge].T, q[edge].T
    crossing = ax + (row + low[1] - ay) * (bx - ax) / (by - ay)
    left = np.clip(np.ceil(crossing) - low[0], 0, width).astype(int)
    flips = np.bincount(row * (width + 1) + left, minlength=height * (width + 1)).reshape(height, width + 1)
    return flips[:, :0:-1].cumsum(axis=1)[:, ::-1] % 2 == 1


def region_score(probability: np.ndarray, p: np.ndarray) -> float:
    """Mean probability of the pixels inside; of the pixel at the centroid if there are none."""
    if not len(p):
        return 0.0
    h, w = probability.shape
    low = np.clip(p.min(axis=0).astype(int), 0, [w - 1, h - 1])
    high = np.clip(p.max(axis=0).astype(int), 0, [w - 1, h - 1])
    own = inside_box(p, low, high)
    if own.any():
        return float(np.float32(probability[low[1] : high[1] + 1, low[0] : high[0] + 1][own].astype(np.float64).mean()))
    cx, cy = np.clip(centroid(p).astype(int), 0, [w - 1, h - 1])
    return float(probability[cy, cx])


def unclip(p: np.ndarray, ratio: float = 1.5) -> np.ndarray:
    """Every edge moved outward by area * ratio / perimeter; vertices follow their bisectors, by four distances at most."""
    around = perimeter(p)
    if len(p) < 3 or around == 0:
        return p
    reach = abs(area(p)) * ratio / around
    edge = _next(p) - p
    size = np.hypot(*edge.T)[:, None]
    unit = np.divide(edge, size, out=np.zeros_like(edge), where=size >= 1e-12)
    normal = np.stack([-unit[:, 1], unit[:, 0]], axis=1)
    if normal[0] @ ((p[0] + p[1]) / 2 - centroid(p)) < 0:
        normal = -normal
    before = np.concatenate((normal[-1:], normal[:-1]))
    middle = before + normal
    size = np.hypot(*middle.T)
    opposed = size < 1e-9
    direction = np.where(opposed[:, None], before, middle / np.where(opposed, 1, size)[:, None])
    cosine = (direction * before).sum(axis=1)
    far = np.where(~opposed & (cosine > 1e-6), reach / np.where(cosine > 1e-6, cosine, 1), reach)
    return p + direction * np.minimum(far, MITER_LIMIT * reach)[:, None]


def detect(probability: np.ndarray, options: DetectOptions = DetectOptions()) -> list[tuple[np.ndarray, float]]:
    """Grown polygons and scores of the regions that are large and likely enough; the cheap test goes first."""
    out = []
    for p in contours(probability >= np.float32(options.threshold)):
        if abs(area(p)) < options.min_area:
            continue
        score = region_score(probability, p)
        if score >= options.min_score:
            out.append((unclip(p, options.unclip_ratio), score))
    return out


def line_polygon(contour: np.ndarray, points: int = 8) -> np.ndarray:
    """The arcs from the leftmost to the rightmost vertex and back, each with ``points`` vertices picked by index."""
    if len(contour) < 3 or points < 2:
        raise GeometryError(f"{len(contour)} vertices, {points} points an edge")
    n, left, right = len(contour), int(contour[:, 0].argmin()), int(contour[:, 0].argmax())

    def arc(a: int, b: int) -> np.ndarray:
        own = contour[(a + np.arange((b - a) % n + 1)) % n]
        return own[(np.arange(points) / (points - 1) * (len(own) - 1)).astype(int)]

    return np.concatenate([arc(left, right), arc(right, left)])
