"""Geometry as expressions over arrays of struct(x, y), and least-squares fits as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _next(p: Column) -> Column:
    """The polygon turned by one vertex."""
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _edges(p: Column, term) -> Column:
    return _total(F.zip_with(p, _next(p), term))


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def length(a: Column) -> Column:
    return F.hypot(a["x"], a["y"])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def scale(a: Column, s: Column) -> Column:
    return point(a["x"] * s, a["y"] * s)


def area(p: Column) -> Column:
    """Signed area; 0 for fewer than three vertices."""
    return F.when(F.size(p) < 3, 0.0).otherwise(_edges(p, cross) / 2)


def perimeter(p: Column) -> Column:
    """Closed length; 0 for fewer than two vertices."""
    return F.when(F.size(p) < 2, 0.0).otherwise(_edges(p, distance))


def centroid(p: Column) -> Column:
    """Centre of the area; the mean of the vertices if there is hardly any area; the origin without vertices."""
    a = area(p)
    mean = point(_total(p.getField("x")) / F.size(p), _total(p.getField("y")) / F.size(p))
    cx = _edges(p, lambda u, v: (u["x"] + v["x"]) * cross(u, v))
    cy = _edges(p, lambda u, v: (u["y"] + v["y"]) * cross(u, v))
    flat = (F.size(p) < 3) | (F.abs(a) < 1e-9)
    return F.when(F.size(p) == 0, point(F.lit(0), F.lit(0))).when(flat, mean).otherwise(point(F.try_divide(cx, 6 * a), F.try_divide(cy, 6 * a)))


def bounds(p: Column) -> Column:
    """struct(x0, y0, x1, y1); zeros without vertices."""
    parts = (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))
    return F.struct(*[F.coalesce(pick(p.getField(axis)), F.lit(0.0)).alias(n) for n, pick, axis in parts])


def contains(p: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: left and top edges of an upright shape count, right and bottom ones do not."""

    def crossing(v: Column, w: Column) -> Column:
        at = v["x"] + F.try_divide((y - v["y"]) * (w["x"] - v["x"]), w["y"] - v["y"])
        return F.when(((v["y"] > y) != (w["y"] > y)) & (x < at), 1.0).otherwise(0.0)

    return _edges(p, crossing) % 2 == 1


def evaluate(coefficients: Column, x: Column) -> Column:
    """Polynomial with ascending coefficients."""
    return F.aggregate(coefficients, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("p")), lambda a, c: F.struct((a["s"] + c * a["p"]).alias("s"), (a["p"] * x).alias("p")), lambda a: a["s"])


def derivative(coefficients: Column) -> Column:
    rest = F.transform(F.slice(coefficients, 2, F.greatest(F.size(coefficients) - 1, F.lit(0))), lambda c, i: c * (i + 1))
    return F.when(F.size(coefficients) <= 1, F.array(F.lit(0.0))).otherwise(rest)


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    """Projective map by nine values, row by row; null where the denominator is zero."""
    w = h[6] * x + h[7] * y + h[8]
    return point(F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w))


def invert_homography(h: Column) -> Column:
    """Adjugate over determinant; null if the determinant is below 1e-12."""
    m = [h[i] for i in range(9)]

    def minor(a: int, b: int, c: int, d: int) -> Column:
        return m[a] * m[b] - m[c] * m[d]

    adjugate = [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]
    det = m[0] * adjugate[0] + m[1] * adjugate[3] + m[2] * adjugate[6]
    return F.when(F.abs(det) >= 1e-12, F.array(*[F.try_divide(a, det) for a in adjugate]))


def fit_lines(points: DataFrame, key: str) -> DataFrame:
    """key, intercept, slope of the least-squares line through points(key, x, y); null where x does not vary."""
    return points.groupBy(key).agg(F.regr_intercept("y", "x").alias("intercept"), F.regr_slope("y", "x").alias("slope"))


def fit_parabolas(points: DataFrame, key: str) -> DataFrame:
    """key, c0, c1, c2 of the least-squares parabola, from power sums in one aggregation; null for fewer than three places."""
    sums = points.groupBy(key).agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(3)])
    matrix = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    right = [F.col(f"t{i}") for i in range(3)]

    def det(a: list[list[Column]]) -> Column:
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    whole = det(matrix)
    solved = [F.when(F.abs(whole) > 1e-12, F.try_divide(det([[right[i] if j == k else matrix[i][j] for j in range(3)] for i in range(3)]), whole)).alias(f"c{k}") for k in range(3)]
    return sums.select(key, *solved)


def line_shapes(baselines: DataFrame, key: str) -> DataFrame:
    """key, angle, linear_bow, curve_bow of baselines(key, x, y): largest distances from the fitted line and parabola."""
    fits = fit_lines(baselines, key).join(fit_parabolas(baselines, key), key)
    rows = baselines.join(fits, key)
    x, y = F.col("x"), F.col("y")
    linear, curve = F.abs(y - F.col("intercept") - F.col("slope") * x), F.abs(y - F.col("c0") - F.col("c1") * x - F.col("c2") * x * x)
    out = rows.groupBy(key).agg(F.atan(F.first("slope")).alias("angle"), F.max(linear).alias("linear_bow"), F.max(curve).alias("curve"))
    return out.select(key, "angle", "linear_bow", F.coalesce("curve", "linear_bow").alias("curve_bow"))


def classify(angle: Column, linear_bow: Column, curve_bow: Column, straight: float | Column = 1.5, curved: float | Column = 1.5, tilt: float = 0.017453292519943295) -> Column:
    """Level 0 to 3: upright, tilted, curved, not readable."""
    return F.when(curve_bow > curved, 3).when(linear_bow > straight, 2).when(F.abs(angle) > tilt, 1).otherwise(0)


def level_name(level: Column) -> Column:
    return F.concat(F.lit("N"), level.cast("string"))
