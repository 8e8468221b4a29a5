"""Every operator of tensor graphs as the planner runs it: a model file is written, parsed, planned, broadcast and run over embeddings.

Components are made multiples of 1/16, so most results are exact in float32 and the SQL can be held to the last digit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliolens.plans.graph import plan, run_on
from foliolens.plans.kernels import conv_size, transposed_size
from foliolens.queries.derived import table
from foliolens.queries.tensors import _I, _axis_sql, _conv_sql, _pool_sql, _transposed_sql, _weight
from foliolens.sources.onnx import Node, model_bytes, node_frame, parse

F32 = np.float32

#: vec_id, p, c, y, x, v, e: 64 components v of each vector, and the vector itself.
Q = f"(SELECT vec_id, 0 AS c, y, x, y * 8 + x AS p, floor(64 * v) / 16 AS v, embedding AS e FROM {_I} i JOIN embeddings USING (vec_id))"


def _at(p: str) -> str:
    """The component at a place from 0."""
    return f"(floor(64 * CAST(e[CAST({p} AS BIGINT) + 1] AS DOUBLE)) / 16)"


def tensors(s, d, shape):
    data = F.transform("embedding", lambda v: (F.floor(v.cast("double") * 64) / 16).cast("float"))
    return table(s, d, "embeddings").select("vec_id", F.array(*map(F.lit, shape)).alias("shape"), data.alias("data"))


def node(op: str, inputs: str = "x", output: str = "y", **attributes) -> Node:
    """Inputs by letters; a dot is an absent one."""
    return Node(op, [i.replace(".", "") for i in inputs], [output], op, "", attributes)


def model(nodes: list[Node], shape, weights=None):
    return parse(model_bytes(nodes, {"x": list(shape)}, ["y"], weights))


def _run(nodes, shape, weights=None, digits=6):
    def build(s, d):
        out = run_on(tensors(s, d, shape), plan(model(nodes, shape, weights)), "vec_id")
        rows = out.select("vec_id", F.array_join("shape", "x").alias("shape"), F.posexplode("data").alias("p", "v"))
        return rows.select("vec_id", "shape", "p", (F.round(F.col("v").cast("double"), digits) + 0.0).alias("v"))

    return build


def _case(nodes, shape, out, v="v", weights=None, digits=6, p="p", source=Q, where="", group=""):
    """A query and the SQL of place p and value v of its results, of shape ``out``."""
    sql = f"SELECT vec_id, '{out}' AS shape, CAST({p} AS INTEGER) AS p, 0.0 + round(CAST({v} AS DOUBLE), {digits}) AS v FROM {source} q {where and f'WHERE {where}'} {group and f'GROUP BY {group}'}"
    return _run(nodes, shape, weights, digits), sql


def _grid(nodes, out, sql, weights=None, digits=6, channel="c", shape=(1, 1, 8, 8)):
    """A query of images, against SQL over the images of the relational operators, rounded to four digits; here they are of the same components."""
    n, m = out[2:]
    flat = sql.replace(_I, Q).replace(", 4) AS v", f", {digits}) AS v")
    return _run(nodes, shape, weights, digits), f"SELECT vec_id, '{'x'.join(map(str, out))}' AS shape, CAST(({channel} * {n} + y) * {m} + x AS INTEGER) AS p, 0.0 + v AS v FROM ({flat}) g"


def _kernels(outputs: int, k: int) -> np.ndarray:
    return np.array([[[[_weight(o, y, x) for x in range(k)] for y in range(k)]] for o in range(outputs)], F32)


I64 = lambda *v: np.array(v, np.int64)
M, FLAT, IMAGE = (8, 8), (64,), (1, 1, 8, 8)
_CHANNELS = (1, 2, 4, 8)
_SIMPLE = {
    "Relu": ({}, "CASE WHEN v > 0 THEN v ELSE 0 END", 6), "LeakyRelu": ({"alpha": 0.25}, "CASE WHEN v > 0 THEN v ELSE v / 4 END", 6), "HardSigmoid": ({"alpha": 0.25, "beta": 0.5}, "least(greatest(v / 4 + 0.5, 0), 1)", 6),
    "HardSwish": ({}, "v * least(greatest(v / 6 + 0.5, 0), 1)", 3), "Sigmoid": ({}, "1 / (1 + exp(-v))", 4), "Tanh": ({}, "tanh(v)", 4), "Identity": ({}, "v", 6), "Dropout": ({}, "v", 6),
}
_ROW = node("Slice", "xseaz", "r")
_ROW_AT = {"s": I64(0), "e": I64(1), "a": I64(0), "z": I64(1)}
_BINARY = {"Add": "v + " + _at("x"), "Sub": "v - " + _at("x"), "Mul": "v * " + _at("x")}
_POWERS = np.array([0.25, -0.5, 1, 2, -4, 8, 0.125, 1], F32)
_N3 = conv_size(8, 3, 2, 1, 1)
_T = transposed_size(8, 3, 2, 1, 1)


def _resize(mode, coordinates, near, out, sql, sizes=False, digits=6):
    weights = {"z": I64(1, 1, *out)} if sizes else {"s": np.array([1, 1, out[0] / 8, out[1] / 8], F32)}
    attributes = {"mode": mode, "coordinate_transformation_mode": coordinates} | ({"nearest_mode": near} if near else {})
    return _grid([node("Resize", "x..z" if sizes else "x.s", **attributes)], (1, 1, *out), sql, weights, digits)


def _nearest_sql(n: int, m: int, y: str, x: str) -> str:
    return f"SELECT vec_id, 0 AS c, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, v FROM {_I} i, range({n}) AS a(oy), range({m}) AS b(ox) WHERE y = {y} AND x = {x}"


def _linear_sql(n: int, m: int, axis=_axis_sql) -> str:
    corners = "CASE k WHEN 0 THEN (1 - ay.t) * (1 - ax.t) WHEN 1 THEN (1 - ay.t) * ax.t WHEN 2 THEN ay.t * (1 - ax.t) ELSE ay.t * ax.t END"
    return f"""SELECT i.vec_id, 0 AS c, ay.oy AS y, ax.ox AS x, round(sum(i.v * {corners}), 4) AS v
FROM {axis(8, n, "y")} ay, {axis(8, m, "x")} ax, range(4) AS q(k) JOIN {_I} i ON i.y = CASE WHEN k < 2 THEN ay.low ELSE ay.high END AND i.x = CASE WHEN k % 2 = 0 THEN ax.low ELSE ax.high END GROUP BY ALL"""


def _corner_axis(n: int, m: int, name: str) -> str:
    """Coordinates with aligned corners."""
    at = f"(o * {n - 1} / {m - 1}.0)"
    return f"(SELECT CAST(o AS INTEGER) AS o{name}, CAST(floor({at}) AS BIGINT) AS low, least(CAST(floor({at}) AS BIGINT) + 1, {n - 1}) AS high, {at} - floor({at}) AS t FROM range({m}) AS r(o))"


def _nodes(s, d):
    nodes = [node("Conv", "xw", "t", strides=[2, 2]), node("Relu", "t", "u"), node("Flatten", "u")]
    return node_frame(s, model(nodes, IMAGE, {"w": _kernels(3, 3)})).select(F.col("position").cast("int").alias("position"), F.col("op").alias("op"))


_PER_CHANNEL = "CASE WHEN y < 4 THEN {} ELSE {} END"
_DILATED = f"""SELECT vec_id, 0 AS o, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(sum(v * ((ky * 3 + kx * 2) % 7 - 3) / 4.0), 4) AS v
FROM range(4) AS a(oy), range(4) AS b(ox), range(3) AS k(ky), range(3) AS l(kx), {_I} i WHERE i.y = oy + 2 * ky AND i.x = ox + 2 * kx GROUP BY ALL"""
_GROUPED = f"""SELECT vec_id, y // 4 AS o, y % 4 AS y, x, round(v * ((y // 4 * 5) % 7 - 3) / 4.0 + (y // 4) - 0.5, 4) AS v FROM {_I} i"""

QUERIES = {
    **{f"graph_{op.lower()}": _case([node(op, **a)], M, "8x8", v, digits=n) for op, (a, v, n) in _SIMPLE.items()},
    **{f"graph_{op.lower()}": _case([_ROW, node(op, "xr")], M, "8x8", v, _ROW_AT) for op, v in _BINARY.items()},
    "graph_div": _case([node("Div", "xw")], M, "8x8", f"v / (CASE x {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(_POWERS.tolist()))} END)", {"w": _POWERS}),
    "graph_pow": _case([node("Pow", "xw")], M, "8x8", "v * v", {"w": np.array(2.0, F32)}),
    "graph_sqrt": _case([node("Relu", "x", "t"), node("Sqrt", "t")], M, "8x8", "sqrt(greatest(v, 0))", digits=4),
    "graph_clip": _case([node("Clip", "xab")], M, "8x8", "least(greatest(v, -0.5), 0.25)", {"a": np.array(-0.5, F32), "b": np.array(0.25, F32)}),
    "graph_prelu": _case([node("PRelu", "xs")], _CHANNELS, "1x2x4x8", f"CASE WHEN v > 0 THEN v ELSE v * {_PER_CHANNEL.format(0.5, -0.25)} END", {"s": np.array([0.5, -0.25], F32).reshape(2, 1, 1)}),
    "graph_batchnormalization": _case(
        [node("BatchNormalization", "xghmv", epsilon=0.0)], _CHANNELS, "1x2x4x8", _PER_CHANNEL.format("(v - 0.5) / 2 * 1.5 - 0.25", "(v + 1) / 0.5 * 0.75 + 1"),
        {"g": np.array([1.5, 0.75], F32), "h": np.array([-0.25, 1], F32), "m": np.array([0.5, -1], F32), "v": np.array([4, 0.25], F32)},
    ),
    "graph_softmax": _case([node("Softmax", axis=1)], M, "8x8", "exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id, y)", digits=3, source=f"(SELECT *, max(v) OVER (PARTITION BY vec_id, y) AS m FROM {Q} z)"),
    "graph_reducemean": _case([node("ReduceMean", axes=[1], keepdims=0)], M, "8", "avg(v)", p="y", group="vec_id, y"),
    "graph_gemm": _case(
        [node("Flatten", "x", "t", axis=1), node("Gemm", "twb", transB=1)], M, "8x4", "sum(v * ((j * 5 + x * 3) % 7 - 3) / 4.0) + j - 0.5",
        {"w": np.array([[_weight(j, k, 0) for k in range(8)] for j in range(4)], F32), "b": np.arange(4, dtype=F32) - F32(0.5)}, p="y * 4 + j", source=f"range(4) AS r(j), {Q}", group="vec_id, y, j",
    ),
    "graph_matmul": _case([node("Transpose", "x", "t", perm=[1, 0]), node("MatMul", "xt")], M, "8x8", f"sum(v * {_at('j * 8 + x')})", p="y * 8 + j", source=f"range(8) AS r(j), {Q}", group="vec_id, y, j"),
    "graph_flatten": _case([node("Flatten", axis=2)], _CHANNELS, "2x32"),
    "graph_reshape": _case([node("Reshape", "xs")], M, "8x2x4", weights={"s": I64(0, -1, 4)}),
    "graph_transpose": _case([node("Transpose", perm=[0, 3, 1, 2])], _CHANNELS, "1x8x2x4", p="x * 8 + y"),
    "graph_concat": _case([node("Concat", "xx", axis=1)], M, "8x16", p="y * 16 + h * 8 + x", source=f"range(2) AS r(h), {Q}"),
    "graph_unsqueeze": _case([node("Unsqueeze", "xa")], M, "1x8x8x1", weights={"a": I64(0, -1)}),
    "graph_squeeze": _case([node("Squeeze", "xa")], (1, 8, 1, 8), "8x8", weights={"a": I64(0, 2)}),
    "graph_shape": _case([node("Shape", start=1)], _CHANNELS, "3", "CASE p WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END", where="p < 3"),
    "graph_slice": _case([node("Slice", "xseaz")], M, "8x3", weights={"s": I64(-1), "e": I64(-8), "a": I64(1), "z": I64(-3)}, p="y * 3 + (7 - x) // 3", where="x IN (7, 4, 1)"),
    "graph_constant": _case([node("Constant", "", "k", value=np.arange(8, dtype=F32)), node("Add", "xk")], M, "8x8", "v + x"),
    "graph_conv": _grid([node("Conv", "xw", strides=[2, 2], pads=[1, 1, 1, 1])], (1, 3, _N3, _N3), _conv_sql(3, 3, 2, 1), {"w": _kernels(3, 3)}, channel="o"),
    "graph_conv_dilated": _grid([node("Conv", "xw", dilations=[2, 2])], (1, 1, 4, 4), _DILATED, {"w": _kernels(1, 3)}, channel="o"),
    "graph_conv_grouped": _grid([node("Conv", "xwb", group=2)], (1, 2, 4, 8), _GROUPED, {"w": _kernels(2, 1), "b": np.array([-0.5, 0.5], F32)}, channel="o", shape=_CHANNELS),
    "graph_convtranspose": _grid([node("ConvTranspose", "xw", strides=[2, 2], pads=[1, 1, 1, 1])], (1, 2, _T, _T), _transposed_sql(3, 2, 1), {"w": _kernels(2, 3).reshape(1, 2, 3, 3)}, channel="o"),
    "graph_maxpool": _grid([node("MaxPool", kernel_shape=[3, 3], strides=[2, 2], pads=[1, 1, 1, 1])], (1, 1, _N3, _N3), _pool_sql("max(v)", 3, 2, 1)),
    "graph_averagepool": _grid([node("AveragePool", kernel_shape=[3, 3], strides=[2, 2], pads=[1, 1, 1, 1])], (1, 1, _N3, _N3), _pool_sql("avg(v)", 3, 2, 1), digits=4),
    "graph_averagepool_padding": _grid([node("AveragePool", kernel_shape=[3, 3], strides=[2, 2], pads=[1, 1, 1, 1], count_include_pad=1)], (1, 1, _N3, _N3), _pool_sql("sum(v) / 9", 3, 2, 1), digits=4),
    "graph_globalaveragepool": _case([node("GlobalAveragePool")], _CHANNELS, "1x2x1x1", "avg(v)", p="y // 4", group="vec_id, y // 4"),
    "graph_resize_floor": _resize("nearest", "asymmetric", "floor", (16, 12), _nearest_sql(16, 12, "oy // 2", "ox * 2 // 3")),
    "graph_resize_half_pixel": _resize("nearest", "half_pixel", "round_prefer_floor", (16, 4), _nearest_sql(16, 4, "oy // 2", "ox * 2")),
    "graph_resize_linear": _resize("linear", "half_pixel", "", (16, 4), _linear_sql(16, 4)),
    "graph_resize_corners": _resize("linear", "align_corners", "", (15, 29), _linear_sql(15, 29, _corner_axis), sizes=True),
    "onnx_nodes": (_nodes, "SELECT CAST(i AS INTEGER) AS position, op FROM (VALUES (0, 'Conv'), (1, 'Relu'), (2, 'Flatten')) AS v(i, op)"),
}
