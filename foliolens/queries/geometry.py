"""Polygons, fits, maps and levels over shapes made from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import geometry as E
from foliolens.queries.derived import table

N = 8


def _value(i: int):
    return F.element_at("embedding", i + 1).cast("double")


def _polygons(s, d):
    """Star-shaped octagons: vertex i lies at i eighths of a turn, as far out as two components say."""
    vertices = [E.point(F.cos(F.lit(i) * F.pi() / 4) * (1 + F.abs(_value(i))), F.sin(F.lit(i) * F.pi() / 4) * (1 + F.abs(_value(i + N)))) for i in range(N)]
    return table(s, d, "embeddings").select("vec_id", "label", F.array(*vertices).alias("p"))


_P = """(SELECT vec_id, label, i, cos(i * pi() / 4) * (1 + abs(CAST(embedding[i + 1] AS DOUBLE))) AS x, sin(i * pi() / 4) * (1 + abs(CAST(embedding[i + 9] AS DOUBLE))) AS y FROM embeddings, range(8) AS r(i))"""
_EDGES = f"""(SELECT a.vec_id, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM {_P} a JOIN {_P} b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 8)"""


def _shape(columns):
    return lambda s, d: _polygons(s, d).select("vec_id", *columns())


def r(c, n=6):
    return F.round(c, n)


_CENTRE = f"""SELECT vec_id, round(sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)), 6) AS x, round(sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)), 6) AS y FROM {_EDGES} GROUP BY vec_id"""


def _points(s, d):
    """Twelve points of each vector: x is the index, y the component."""
    return table(s, d, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 12)).alias("i", "y")).select("vec_id", "label", F.col("i").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


_PTS = "(SELECT vec_id, label, CAST(i AS DOUBLE) AS x, CAST(embedding[i + 1] AS DOUBLE) AS y FROM embeddings, range(12) AS r(i))"
_LINE = f"(SELECT vec_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM {_PTS} GROUP BY vec_id)"
#: Parabola over orthogonal terms: 1, x - 5.5, and (x - 5.5)^2 less its mean.
_PARABOLA = f"""(SELECT vec_id, avg(y) AS m, sum(y * (x - 5.5)) / sum((x - 5.5) * (x - 5.5)) AS b, sum(y * q) / sum(q * q) AS c FROM (SELECT *, (x - 5.5) * (x - 5.5) - 143 / 12.0 AS q FROM {_PTS}) GROUP BY vec_id)"""
_SHAPES = f"""SELECT vec_id, atan(any_value(l.b)) AS angle, max(abs(y - l.a - l.b * x)) AS linear_bow, max(abs(y - p.m - p.b * (x - 5.5) - p.c * ((x - 5.5) * (x - 5.5) - 143 / 12.0))) AS curve_bow
FROM {_PTS} t JOIN {_LINE} l USING (vec_id) JOIN {_PARABOLA} p USING (vec_id) GROUP BY vec_id"""
_LEVEL = "CASE WHEN curve_bow > 0.27 THEN 3 WHEN linear_bow > 0.2 THEN 2 WHEN abs(angle) > 0.01 THEN 1 ELSE 0 END"


def _shapes(s, d):
    return E.line_shapes(_points(s, d), "vec_id")


def _levels(s, d):
    return _shapes(s, d).select("vec_id", E.classify(F.col("angle"), F.col("linear_bow"), F.col("curve_bow"), 0.2, 0.27, 0.01).alias("level"))


def _maps(s, d):
    """A homography near the identity for each vector."""
    h = F.array(*[(_value(i) / 4 + (1.0 if i in (0, 4) else 0.0)) if i < 8 else F.lit(4.0) for i in range(9)])
    return table(s, d, "embeddings").select("vec_id", h.alias("h"))


_H = "(SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) / 4 + {1.0 if i in (0, 4) else 0.0} AS h{i}" for i in range(8)) + ", 4.0 AS h8 FROM embeddings)"


def _round_trip(s, d):
    there = _maps(s, d).withColumn("q", E.apply_homography(F.col("h"), F.lit(3.0), F.lit(-2.0)))
    back = E.apply_homography(E.invert_homography(F.col("h")), F.col("q.x"), F.col("q.y"))
    return there.select("vec_id", back.alias("b")).select("vec_id", r("b.x").alias("x"), r("b.y").alias("y"))


def _vectors(s, d):
    a, b = E.point(_value(0), _value(1)), E.point(_value(2), _value(3))
    rows = table(s, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    moved = E.subtract(E.add(E.scale(a, F.lit(2.0)), b), a)
    return rows.select("vec_id", r(moved["x"]).alias("x"), r(moved["y"]).alias("y"), r(E.dot(a, b)).alias("dot"), r(E.cross(a, b)).alias("cross_"), r(E.length(a)).alias("len"), r(E.distance(a, b)).alias("dist"))


QUERIES = {
    "point_ops": (
        _vectors,
        "WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e FROM embeddings) "
        "SELECT vec_id, round(a + c, 6) AS x, round(b + e, 6) AS y, round(a * c + b * e, 6) AS dot, round(a * e - c * b, 6) AS cross_, round(sqrt(a * a + b * b), 6) AS len, round(sqrt((a - c) ** 2 + (b - e) ** 2), 6) AS dist FROM v",
    ),
    "poly_area": (_shape(lambda: [r(E.area(F.col("p"))).alias("area")]), f"SELECT vec_id, round(sum(px * qy - qx * py) / 2, 6) AS area FROM {_EDGES} GROUP BY vec_id"),
    "poly_perimeter": (_shape(lambda: [r(E.perimeter(F.col("p"))).alias("length")]), f"SELECT vec_id, round(sum(sqrt((px - qx) ** 2 + (py - qy) ** 2)), 6) AS length FROM {_EDGES} GROUP BY vec_id"),
    "poly_centroid": (lambda s, d: _polygons(s, d).select("vec_id", E.centroid(F.col("p")).alias("c")).select("vec_id", r("c.x").alias("x"), r("c.y").alias("y")), _CENTRE),
    "poly_bounds": (
        lambda s, d: _polygons(s, d).select("vec_id", E.bounds(F.col("p")).alias("b")).select("vec_id", *[r(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]),
        f"SELECT vec_id, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM {_P} GROUP BY vec_id",
    ),
    "poly_contains": (
        lambda s, d: _polygons(s, d).join(table(s, d, "embeddings").select("vec_id", (_value(20) * 8).alias("x"), (_value(21) * 8).alias("y")), "vec_id").select("vec_id", E.contains(F.col("p"), F.col("x"), F.col("y")).alias("inside")),
        f"SELECT vec_id, sum(CASE WHEN (py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / (qy - py) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM {_EDGES} JOIN (SELECT vec_id, CAST(embedding[21] AS DOUBLE) * 8 AS x, CAST(embedding[22] AS DOUBLE) * 8 AS y FROM embeddings) USING (vec_id) GROUP BY vec_id",
    ),
    "polyfit1": (lambda s, d: E.fit_lines(_points(s, d), "vec_id").select("vec_id", r("intercept").alias("a"), r("slope").alias("b")), f"SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b FROM {_LINE}"),
    "polyfit2": (
        lambda s, d: E.fit_parabolas(_points(s, d), "vec_id").select("vec_id", *[r(f"c{i}").alias(f"c{i}") for i in range(3)]),
        f"SELECT vec_id, round(m - 5.5 * b + c * (30.25 - 143 / 12.0), 6) AS c0, round(b - 11 * c, 6) AS c1, round(c, 6) AS c2 FROM {_PARABOLA}",
    ),
    "line_shape": (lambda s, d: _shapes(s, d).select("vec_id", *[r(c).alias(c) for c in ("angle", "linear_bow", "curve_bow")]), f"SELECT vec_id, round(angle, 6) AS angle, round(linear_bow, 6) AS linear_bow, round(curve_bow, 6) AS curve_bow FROM ({_SHAPES})"),
    "classify_level": (_levels, f"SELECT vec_id, {_LEVEL} AS level FROM ({_SHAPES})"),
    "level_name": (lambda s, d: _levels(s, d).select("vec_id", E.level_name(F.col("level")).alias("name")), f"SELECT vec_id, 'N' || CAST({_LEVEL} AS VARCHAR) AS name FROM ({_SHAPES})"),
    "page_level": (
        lambda s, d: _levels(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level")),
        f"SELECT label, max({_LEVEL}) AS level FROM ({_SHAPES}) JOIN embeddings USING (vec_id) GROUP BY label",
    ),
    "eval_poly": (lambda s, d: table(s, d, "embeddings").select("vec_id", r(E.evaluate(F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")), F.lit(2.0))).alias("y")), "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + 2 * CAST(embedding[2] AS DOUBLE) + 4 * CAST(embedding[3] AS DOUBLE) + 8 * CAST(embedding[4] AS DOUBLE), 6) AS y FROM embeddings"),
    "derivative": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(E.derivative(F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")))).alias("i", "c")).select("vec_id", "i", r("c").alias("c")),
        "SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 2] AS DOUBLE) * (i + 1), 6) AS c FROM embeddings, range(3) AS r(i)",
    ),
    "homography_apply": (
        lambda s, d: _maps(s, d).select("vec_id", E.apply_homography(F.col("h"), F.lit(3.0), F.lit(-2.0)).alias("q")).select("vec_id", r("q.x").alias("x"), r("q.y").alias("y")),
        f"SELECT vec_id, round((3 * h0 - 2 * h1 + h2) / (3 * h6 - 2 * h7 + h8), 6) AS x, round((3 * h3 - 2 * h4 + h5) / (3 * h6 - 2 * h7 + h8), 6) AS y FROM {_H}",
    ),
    "homography_invert": (_round_trip, "SELECT vec_id, 3.0::DOUBLE AS x, -2.0::DOUBLE AS y FROM embeddings"),
    "arc_length": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.aggregate(F.sequence(F.lit(1), F.lit(511)), F.lit(0.0), lambda a, i: a + (F.hypot(F.lit(1.0), _value(0) * 20 * (i - 1) / 511 + _value(1)) + F.hypot(F.lit(1.0), _value(0) * 20 * i / 511 + _value(1))) / 2 * 10 / 511).alias("s")).select("vec_id", r("s", 5).alias("s")),
        "SELECT vec_id, round(sum((sqrt(1 + (a * 20 * (i - 1) / 511.0 + b) ** 2) + sqrt(1 + (a * 20 * i / 511.0 + b) ** 2)) / 2 * 10 / 511.0), 5) AS s FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), range(1, 512) AS r(i) GROUP BY vec_id",
    ),
}

#: A negative zero that rounding leaves is made zero.
QUERIES = {name: (build, sql.replace("round(", "0.0 + round(")) for name, (build, sql) in QUERIES.items()}
