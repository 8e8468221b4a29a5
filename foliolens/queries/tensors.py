"""Tensor operators over embeddings as [64] vectors and [8, 8] images, each as an expression or a relational plan."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from foliolens.operators import tensors as X
from foliolens.operators.recognition import decode_frame
from foliolens.plans import graph as G
from foliolens.plans.kernels import conv_size, transposed_size
from foliolens.queries.derived import table
from foliolens.sources.onnx import Node



def _rows(s, d):
    return table(s, d, "embeddings")


def _each(data):
    """vec_id, p, v of an array column, rounded; data is a function, as expressions can only be made in a session."""
    return lambda s, d: _rows(s, d).select("vec_id", F.posexplode(data()[0]).alias("p", "v")).select("vec_id", "p", F.round(F.col("v").cast("double"), 4).alias("v"))


_E = "(SELECT vec_id, CAST(p - 1 AS INTEGER) AS p, CAST(embedding[p] AS DOUBLE) AS v, CAST(embedding[65 - p] AS DOUBLE) AS w FROM embeddings, range(1, 65) AS r(p))"


def _each_sql(v: str) -> str:
    return f"SELECT vec_id, p, round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) AS v FROM {_E}"


_HARD = "least(greatest(v * 0.2 + 0.5, 0), 1)"
_UNARY = {
    "Relu": "CASE WHEN v > 0 THEN v ELSE 0 END", "LeakyRelu": "CASE WHEN v > 0 THEN v ELSE v * 0.01 END", "Sigmoid": "1 / (1 + exp(-v))", "Tanh": "tanh(v)", "HardSigmoid": _HARD, "HardSwish": "v * least(greatest(v / 6 + 0.5, 0), 1)",
    "Identity": "v", "Dropout": "v",
}
_BINARY = {"Add": "v + w", "Sub": "v - w", "Mul": "v * w", "Div": "v / w", "Pow": "pow(abs(v), w)"}


def _flipped():
    return F.reverse("embedding")


def _magnitudes():
    return F.transform("embedding", lambda v: F.abs(v))


# ---- exploded

def _image(s, d):
    return X.explode_image(_rows(s, d), "vec_id", 8, 8, "embedding")


_I = "(SELECT vec_id, 0 AS c, p // 8 AS y, p % 8 AS x, v FROM (SELECT vec_id, p - 1 AS p, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(p)))"


def _weight(o: int, ky: int, kx: int) -> float:
    return ((o * 5 + ky * 3 + kx * 2) % 7 - 3) / 4


def _weights(s, outputs: int, k: int):
    rows = [(o, 0, ky, kx, _weight(o, ky, kx)) for o, ky, kx in product(range(outputs), range(k), range(k))]
    return s.createDataFrame(rows, "o int, c int, ky int, kx int, w double")


def _weights_sql(outputs: int, k: int) -> str:
    return f"(SELECT CAST(o AS INTEGER) AS o, ky, kx, ((o * 5 + ky * 3 + kx * 2) % 7 - 3) / 4.0 AS w FROM range({outputs}) AS a(o), range({k}) AS b(ky), range({k}) AS c(kx))"


def _grid_out(df, *names):
    return df.select("vec_id", *[F.col(n).cast("int").alias(n) for n in names], F.round("v", 4).alias("v"))


def _conv(outputs, k, stride, pad):
    n = conv_size(8, k, stride, pad, 1)
    return lambda s, d: _grid_out(X.conv2d(_image(s, d), _weights(s, outputs, k), "vec_id", (n, n), stride, pad), "o", "y", "x")


def _conv_sql(outputs, k, stride, pad):
    n = conv_size(8, k, stride, pad, 1)
    return f"""SELECT vec_id, o, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(sum(v * w), 4) AS v FROM range({n}) AS a(oy), range({n}) AS b(ox), {_weights_sql(outputs, k)} k, {_I} i
WHERE i.y = oy * {stride} + ky - {pad} AND i.x = ox * {stride} + kx - {pad} GROUP BY vec_id, o, oy, ox"""


def _transposed(k, stride, pad):
    n = transposed_size(8, k, stride, pad, 1)
    return lambda s, d: _grid_out(X.conv_transpose2d(_image(s, d), _weights(s, 2, k), "vec_id", (n, n), stride, pad), "o", "y", "x")


def _transposed_sql(k, stride, pad):
    n = transposed_size(8, k, stride, pad, 1)
    return f"""SELECT vec_id, o, CAST(y * {stride} - {pad} + ky AS INTEGER) AS y, CAST(x * {stride} - {pad} + kx AS INTEGER) AS x, round(sum(v * w), 4) AS v FROM {_I} i, {_weights_sql(2, k)} k
WHERE y * {stride} - {pad} + ky BETWEEN 0 AND {n - 1} AND x * {stride} - {pad} + kx BETWEEN 0 AND {n - 1} GROUP BY ALL"""


def _pool(kind, k, stride, pad, count_padding=False):
    n = conv_size(8, k, stride, pad, 1)
    return lambda s, d: _grid_out(X.pool(_image(s, d), "vec_id", k, stride, (n, n), kind, pad, count_padding), "c", "y", "x")


def _pool_sql(value, k, stride, pad):
    n = conv_size(8, k, stride, pad, 1)
    return f"""SELECT vec_id, c, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round({value}, 4) AS v FROM range({n}) AS a(oy), range({n}) AS b(ox), {_I} i
WHERE i.y BETWEEN oy * {stride} - {pad} AND oy * {stride} - {pad} + {k - 1} AND i.x BETWEEN ox * {stride} - {pad} AND ox * {stride} - {pad} + {k - 1} GROUP BY vec_id, c, oy, ox"""


def _matmul(s, d):
    a = _rows(s, d).select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).alias("k"), F.col("v").cast("double").alias("v"))
    b = s.createDataFrame([(k, j, _weight(j, k, 0)) for k, j in product(range(8), range(4))], "k int, j int, w double")
    return X.matmul(a, b, "vec_id").select("vec_id", "i", "j", F.round("v", 4).alias("v"))


def _gram(s, d):
    """The Gram matrix of vectors by label: a general product of two tables."""
    a = _rows(s, d).select(F.col("label").alias("g"), "vec_id", F.posexplode("embedding").alias("k", "v")).select("g", F.col("vec_id").alias("r"), "k", F.col("v").cast("double").alias("v"))
    sums = a.groupBy("g", "k").agg(F.sum("v").alias("v"))
    left = sums.select(F.col("g").alias("i"), "k", "v", F.lit(0).alias("m"))
    return X.matmul(left, sums.select(F.col("g").alias("j"), "k", F.col("v").alias("w")), "m").select("i", "j", F.round("v", 3).alias("v"))


def _nearest(s, d):
    """Nearest neighbours at twice the size, rounding half coordinates down."""
    grid = s.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("oy"), (F.col("id") % 16).cast("int").alias("ox"))
    at = lambda c: F.greatest(F.least(F.ceil((F.col(c) + 0.5) / 2 - 1), F.lit(7)), F.lit(0)).cast("int")
    grid = grid.select("oy", "ox", at("oy").alias("y"), at("ox").alias("x"))
    return _grid_out(_image(s, d).join(F.broadcast(grid), ["y", "x"]).select("vec_id", "c", F.col("oy").alias("y"), F.col("ox").alias("x"), "v"), "c", "y", "x")


def _axis_sql(n: int, m: int, name: str) -> str:
    at = f"least(greatest((o + 0.5) * {n} / {m}.0 - 0.5, 0), {n - 1})"
    return f"(SELECT CAST(o AS INTEGER) AS o{name}, CAST(floor({at}) AS BIGINT) AS low, least(CAST(floor({at}) AS BIGINT) + 1, {n - 1}) AS high, {at} - floor({at}) AS t FROM range({m}) AS r(o))"


_LINEAR_SQL = f"""SELECT i.vec_id, 0 AS c, ay.oy AS y, ax.ox AS x, round(sum(i.v * CASE k WHEN 0 THEN (1 - ay.t) * (1 - ax.t) WHEN 1 THEN (1 - ay.t) * ax.t WHEN 2 THEN ay.t * (1 - ax.t) ELSE ay.t * ax.t END), 4) AS v
FROM {_axis_sql(8, 12, "y")} ay, {_axis_sql(8, 5, "x")} ax, range(4) AS q(k) JOIN {_I} i ON i.y = CASE WHEN k < 2 THEN ay.low ELSE ay.high END AND i.x = CASE WHEN k % 2 = 0 THEN ax.low ELSE ax.high END GROUP BY ALL"""


def _scores(s, d):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (5, 2), (6, 6), (2, 5))])
    return X.region_scores(_image(s, d), _rows(s, d).select("vec_id", square.alias("p")), "vec_id").select("vec_id", F.round("score", 4).alias("score"))


_SQUARE = ((1, 1), (5, 2), (6, 6), (2, 5))
_CROSSINGS = " + ".join(
    f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < {ax} + (y - {ay}) * ({bx} - {ax}) / {float(by - ay)} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_SQUARE, _SQUARE[1:] + _SQUARE[:1], strict=True)
)


def _ctc(s, d):
    steps = _rows(s, d).select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("t"), (F.col("p") % 8).alias("c"), F.col("v").alias("p"))
    classes = s.createDataFrame([(i, "" if not i else chr(96 + i)) for i in range(8)], "c int, text string")
    return decode_frame(steps, classes, "vec_id").select("vec_id", "text", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


_CTC_SQL = f"""WITH b AS (SELECT vec_id, y AS t, arg_max(x, (v, -x)) AS k, max(v) AS p FROM {_I} GROUP BY vec_id, y), e AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM b),
r AS (SELECT vec_id, string_agg(chr(CAST(96 + k AS INTEGER)), '' ORDER BY t) AS text, avg(p) AS confidence FROM e WHERE k <> 0 AND k IS DISTINCT FROM before GROUP BY vec_id)
SELECT v.vec_id, coalesce(text, '') AS text, round(coalesce(confidence, 0), 4) AS confidence FROM embeddings v LEFT JOIN r USING (vec_id)"""


def _topology(s, d):
    """Levels of a layered graph over vectors: each points to the next and the third next of its four."""
    nodes = _rows(s, d).select(F.col("vec_id").alias("a"))
    edges = nodes.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 3)).alias("b")).where(F.floor(F.col("a") / 4) == F.floor(F.col("b") / 4))
    return X.levels(edges.join(nodes.select(F.col("a").alias("b")), "b"), 4)


def _planned_order(s, d):
    """The planner's order of a shuffled graph, as rows."""
    nodes = [Node("Relu", [f"t{i - 1}" if i else "x"], [f"t{i}"]) for i in range(12)]
    shuffled = [nodes[(i * 5) % 12] for i in range(12)]
    return s.createDataFrame([(i, n.outputs[0]) for i, n in enumerate(G.topological(shuffled, {"x"}))], "position int, output string")


def _shapes(s, d):
    shape = F.array(F.lit(2), F.lit(4), F.lit(8))
    return _rows(s, d).select(
        "vec_id", F.array_join(X.flatten_shape(shape, 1), "x").alias("flat"), F.array_join(X.reshape(F.array(F.lit(4), F.lit(-1)), F.size(F.col("embedding"))), "x").alias("reshaped"),
        F.array_join(X.unsqueeze_shape(shape, 0), "x").alias("unsqueezed"), F.array_join(X.squeeze_shape(X.unsqueeze_shape(shape, 3)), "x").alias("squeezed"), F.array_join(F.array(F.size(F.col("embedding"))), "x").alias("shape"),
    )


QUERIES = {
    **{f"op_{n.lower()}": (_each(lambda n=n: [X.unary(n, F.col("embedding"))]), _each_sql(v)) for n, v in _UNARY.items()},
    "op_sqrt": (_each(lambda: [X.unary("Sqrt", _magnitudes())]), _each_sql("sqrt(abs(v))")),
    **{f"op_{n.lower()}": (_each(lambda n=n: [X.binary(n, _magnitudes() if n == "Pow" else F.col("embedding"), _flipped())]), _each_sql(f"CASE WHEN w = 0 THEN CASE WHEN v = 0 OR isnan(v) THEN 'NaN'::DOUBLE WHEN v > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE {v} END" if n == "Div" else v)) for n, v in _BINARY.items()},
    "op_clip": (_each(lambda: [X.clip(F.col("embedding"), -0.05, 0.1)]), _each_sql("least(greatest(v, CAST(-0.05 AS FLOAT)), CAST(0.1 AS FLOAT))")),
    "op_prelu": (_each(lambda: [X.prelu(F.col("embedding"), 0.25)]), _each_sql("CASE WHEN v > 0 THEN v ELSE v * 0.25 END")),
    "op_batchnormalization": (_each(lambda: [X.affine(F.col("embedding"), 1.5, -0.25)]), _each_sql("v * 1.5 - 0.25")),
    "op_softmax": (_each(lambda: [X.softmax(F.col("embedding"))]), "SELECT vec_id, p, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id), 4) AS v FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM " + _E + ")"),
    "op_reducemean": (lambda s, d: _rows(s, d).select("vec_id", F.round(X.mean(F.col("embedding")), 4).alias("v")), f"SELECT vec_id, round(avg(v), 4) AS v FROM {_E} GROUP BY vec_id"),
    "op_transpose": (_each(lambda: [X.transpose2(F.col("embedding"), 8, 8)]), "SELECT vec_id, CAST(x * 8 + y AS INTEGER) AS p, round(v, 4) AS v FROM " + _I),
    "op_concat": (_each(lambda: [F.concat(F.col("embedding"), _flipped())]), f"SELECT vec_id, p, round(v, 4) AS v FROM {_E} UNION ALL SELECT vec_id, p + 64, round(w, 4) FROM {_E}"),
    "op_slice": (_each(lambda: [X.slice1(F.col("embedding"), 60, 3, -4)]), f"SELECT vec_id, CAST((60 - p) // 4 AS INTEGER) AS p, round(v, 4) AS v FROM {_E} WHERE p > 3 AND p <= 60 AND p % 4 = 0"),
    "op_constant": (_each(lambda: [F.array_repeat(F.lit(0.5).cast("float"), 3)]), "SELECT vec_id, CAST(p AS INTEGER) AS p, 0.5::DOUBLE AS v FROM embeddings, range(3) AS r(p)"),
    "op_shapes": (_shapes, "SELECT vec_id, '2x32' AS flat, '4x16' AS reshaped, '1x2x4x8' AS unsqueezed, '2x4x8' AS squeezed, '64' AS shape FROM embeddings"),
    "op_matmul": (_matmul, f"SELECT vec_id, CAST(y AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v * ((j * 5 + x * 3) % 7 - 3) / 4.0), 4) AS v FROM {_I}, range(4) AS r(j) GROUP BY vec_id, y, j"),
    "op_gemm": (_gram, f"WITH s AS (SELECT label, p, sum(v) AS v FROM {_E} JOIN embeddings USING (vec_id) GROUP BY label, p) SELECT a.label AS i, b.label AS j, round(sum(a.v * b.v), 3) AS v FROM s a JOIN s b USING (p) GROUP BY ALL"),
    "op_conv": (_conv(3, 3, 2, 1), _conv_sql(3, 3, 2, 1)),
    "op_conv_depthwise": (_conv(1, 3, 1, 1), _conv_sql(1, 3, 1, 1)),
    "op_convtranspose": (_transposed(3, 2, 1), _transposed_sql(3, 2, 1)),
    "op_maxpool": (_pool("max", 3, 2, 1), _pool_sql("max(v)", 3, 2, 1)),
    "op_averagepool": (_pool("avg", 3, 2, 1), _pool_sql("avg(v)", 3, 2, 1)),
    "op_averagepool_padding": (_pool("avg", 3, 2, 1, True), _pool_sql("sum(v) / 9", 3, 2, 1)),
    "op_globalaveragepool": (lambda s, d: X.global_average(_image(s, d), "vec_id").select("vec_id", "c", F.round("v", 4).alias("v")), f"SELECT vec_id, c, round(avg(v), 4) AS v FROM {_I} GROUP BY vec_id, c"),
    "op_resize_nearest": (_nearest, f"SELECT vec_id, c, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(v, 4) AS v FROM {_I}, range(16) AS a(oy), range(16) AS b(ox) WHERE y = oy // 2 AND x = ox // 2"),
    "op_resize_linear": (lambda s, d: _grid_out(X.resize_bilinear(_image(s, d), "vec_id", 8, 8, 12, 5), "c", "y", "x"), _LINEAR_SQL),
    "box_blur": (
        lambda s, d: _grid_out(X.box_blur(_image(s, d), "vec_id", 2), "c", "y", "x"),
        f"SELECT a.vec_id, a.c, CAST(a.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, round(avg(b.v), 4) AS v FROM {_I} a JOIN {_I} b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL",
    ),
    "binarize": (lambda s, d: X.binarize(_image(s, d), 0.05).groupBy("vec_id").agg(F.count("*").alias("n")), f"SELECT vec_id, count(*) AS n FROM {_I} WHERE v >= 0.05 GROUP BY vec_id"),
    "region_score": (_scores, f"SELECT vec_id, round(avg(v), 4) AS score FROM {_I} WHERE ({_CROSSINGS}) % 2 = 1 GROUP BY vec_id"),
    "ctc_decode": (_ctc, _CTC_SQL),
    "topo_levels": (_topology, "SELECT vec_id AS node, CAST(vec_id % 4 AS INTEGER) AS level FROM embeddings"),
    "topo_order": (_planned_order, "SELECT CAST(i AS INTEGER) AS position, 't' || i AS output FROM range(12) AS r(i)"),
}

#: A negative zero that rounding leaves is made zero.
QUERIES = {name: (build, sql.replace("round(", "0.0 + round(")) for name, (build, sql) in QUERIES.items()}
