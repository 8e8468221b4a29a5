"""Tensor operators without Python: element by element on ARRAY<FLOAT> columns, and as joins and aggregates on exploded
tensors. The graph runtime in ``plans`` is the fast way through a network; these forms are for single operators on tables
of tensors, stay in the JVM, and can be checked against SQL.

Exploded images have key, c, y, x, v; exploded matrices key, i, k, v.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _f(v) -> Column:
    return F.lit(v).cast("double")


#: One value to one value, in double; results are cast to FLOAT.
UNARY: dict[str, Callable[[Column], Column]] = {
    "Relu": lambda v: F.when(v > 0, v).otherwise(0.0),
    "LeakyRelu": lambda v: F.when(v > 0, v).otherwise(v * 0.01),
    "Sigmoid": lambda v: 1 / (1 + F.exp(-v)),
    "Tanh": F.tanh,
    "HardSigmoid": lambda v: F.when(v * 0.2 + 0.5 < 0, 0.0).when(v * 0.2 + 0.5 > 1, 1.0).otherwise(v * 0.2 + 0.5),
    "HardSwish": lambda v: v * F.when(v / 6 + 0.5 < 0, 0.0).when(v / 6 + 0.5 > 1, 1.0).otherwise(v / 6 + 0.5),
    "Sqrt": F.sqrt,
    "Identity": lambda v: v,
    "Dropout": lambda v: v,
}


def unary(op: str, data: Column) -> Column:
    return F.transform(data, lambda v: UNARY[op](v.cast("double")).cast("float"))


def clip(data: Column, low: float, high: float) -> Column:
    """NaN passes through."""
    return F.transform(data, lambda v: F.when(v < low, _f(low)).when((v > high) & ~F.isnan(v), _f(high)).otherwise(v.cast("double")).cast("float"))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN where the divisor is zero."""
    by_zero = F.when(F.isnan(a) | (a == 0), _f("NaN")).when(a > 0, _f("Infinity")).otherwise(_f("-Infinity"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


BINARY: dict[str, Callable[[Column, Column], Column]] = {"Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "Mul": lambda a, b: a * b, "Div": divide, "Pow": F.pow}


def binary(op: str, a: Column, b: Column) -> Column:
    """Two tensors of one shape."""
    return F.zip_with(a, b, lambda x, y: BINARY[op](x.cast("double"), y.cast("double")).cast("float"))


def prelu(data: Column, slope: float) -> Column:
    return F.transform(data, lambda v: F.when(v > 0, v.cast("double")).otherwise(v * _f(slope)).cast("float"))


def softmax(data: Column) -> Column:
    """Over the whole array."""
    peak = F.array_max(data).cast("double")
    e = F.transform(data, lambda v: F.exp(v.cast("double") - peak))
    total = F.aggregate(e, _f(0), lambda s, v: s + v)
    return F.transform(e, lambda v: (v / total).cast("float"))


def affine(data: Column, scale: float, shift: float) -> Column:
    """Batch normalisation of one channel."""
    return F.transform(data, lambda v: (v * _f(scale) + _f(shift)).cast("float"))


def mean(data: Column) -> Column:
    return F.aggregate(data, _f(0), lambda s, v: s + v.cast("double"), lambda s: s / F.size(data))


# ---- shapes: struct(shape, data)

def transpose2(data: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.element_at(data, (i % rows * columns + F.floor(i / rows)).cast("int") + 1))


def reshape(shape: Column, size: Column) -> Column:
    """A shape whose -1, if any, is what is left."""
    known = F.aggregate(shape, F.lit(1), lambda a, d: F.when(d == -1, a).otherwise(a * d))
    return F.transform(shape, lambda d: F.when(d == -1, F.floor(F.try_divide(size, known)).cast("int")).otherwise(d))


def flatten_shape(shape: Column, axis: int) -> Column:
    size = lambda part: F.aggregate(part, F.lit(1), lambda a, d: a * d)
    return F.array(size(F.slice(shape, 1, axis)) if axis else F.lit(1), size(F.slice(shape, axis + 1, F.size(shape))))


def unsqueeze_shape(shape: Column, axis: int) -> Column:
    return F.array_insert(shape, axis + 1, F.lit(1))


def squeeze_shape(shape: Column) -> Column:
    return F.filter(shape, lambda d: d != 1)


def slice1(data: Column, start: int, end: int, step: int = 1) -> Column:
    """One-dimensional slice from start up to end, both within the array."""
    return F.transform(F.sequence(F.lit(start), F.lit(end - (1 if step > 0 else -1)), F.lit(step)), lambda i: F.element_at(data, i + 1))


# ---- exploded

def explode_image(tensors: DataFrame, key: str, height: int, width: int, data: str = "data") -> DataFrame:
    """key, c, y, x, v of [C, H, W] tensors."""
    rows = tensors.select(key, F.posexplode(data).alias("p", "v"))
    return rows.select(key, F.floor(F.col("p") / (height * width)).cast("int").alias("c"), (F.floor(F.col("p") / width) % height).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def matmul(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, i, j, v of a(key, i, k, v) times b(k, j, w): one equi-join on k and a sum with map-side combine."""
    return a.join(b, "k").groupBy(key, "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def _output(place: str, offset: str, stride: int, pad: int, dilation: int) -> Column:
    return F.col(place) + pad - F.col(offset) * dilation


def conv2d(image: DataFrame, weights: DataFrame, key: str, size: tuple[int, int], stride: int = 1, pad: int = 0, dilation: int = 1) -> DataFrame:
    """key, o, y, x, v: every pixel meets every weight of its channel in weights(o, c, ky, kx, w), and lands in the output
    cell for which the weight is over it. ``size`` is the output's. Groups and depthwise weights are a matter of which
    (o, c) pairs the weights have."""
    hit = image.join(F.broadcast(weights), "c")  # weights are of fixed size, not a table
    y, x = _output("y", "ky", stride, pad, dilation), _output("x", "kx", stride, pad, dilation)
    hit = hit.select(key, "o", "v", "w", y.alias("sy"), x.alias("sx")).where(f"sy % {stride} = 0 AND sx % {stride} = 0")
    hit = hit.select(key, "o", "v", "w", (F.col("sy") / stride).cast("int").alias("y"), (F.col("sx") / stride).cast("int").alias("x"))
    inside = hit.where(f"sign(y) >= 0 AND sign(x) >= 0 AND y < {size[0]} AND x < {size[1]}")
    return inside.groupBy(key, "o", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def conv_transpose2d(image: DataFrame, weights: DataFrame, key: str, size: tuple[int, int], stride: int = 1, pad: int = 0, dilation: int = 1) -> DataFrame:
    """key, o, y, x, v: every pixel spreads the kernel of its channel over the output."""
    hit = image.join(F.broadcast(weights), "c")  # weights are of fixed size, not a table
    hit = hit.select(key, "o", (F.col("y") * stride - pad + F.col("ky") * dilation).alias("y"), (F.col("x") * stride - pad + F.col("kx") * dilation).alias("x"), (F.col("v") * F.col("w")).alias("v"))
    return hit.where(f"y >= 0 AND x >= 0 AND y < {size[0]} AND x < {size[1]}").groupBy(key, "o", "y", "x").agg(F.sum("v").alias("v"))


def pool(image: DataFrame, key: str, kernel: int, stride: int, size: tuple[int, int], kind: str = "max", pad: int = 0, count_padding: bool = False) -> DataFrame:
    """key, c, y, x, v by windows of kernel x kernel; padding never wins a maximum and counts for a mean only if asked."""
    def cells(place: str, n: int) -> Column:
        """Outputs whose window covers the place."""
        at = F.col(place) + pad
        first = F.greatest(F.lit(0), F.ceil((at - kernel + 1) / stride)).cast("int")
        last = F.least(F.lit(n - 1), F.floor(at / stride)).cast("int")
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))

    rows = image.select(key, "c", "x", "v", cells("y", size[0]).alias("oy")).select(key, "c", "oy", "v", cells("x", size[1]).alias("ox"))
    value = F.max("v") if kind == "max" else F.sum("v") / (kernel * kernel) if count_padding else F.avg("v")
    return rows.groupBy(key, "c", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(value.alias("v"))


def global_average(image: DataFrame, key: str) -> DataFrame:
    return image.groupBy(key, "c").agg(F.avg("v").alias("v"))


def box_blur(image: DataFrame, key: str, radius: int) -> DataFrame:
    """key, c, y, x, v: separable window sums over counts."""
    across = Window.partitionBy(key, "c", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy(key, "c", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = image.withColumn("s", F.sum("v").over(across)).withColumn("n", F.count("v").over(across))
    return rows.select(key, "c", "y", "x", (F.sum("s").over(down) / F.sum("n").over(down)).alias("v"))


def resize_bilinear(image: DataFrame, key: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """key, c, y, x, v with aligned pixel centres: a grid of outputs joined with its four neighbours."""
    grid = image.sparkSession.range(new_height * new_width).select(F.floor(F.col("id") / new_width).cast("int").alias("y"), (F.col("id") % new_width).cast("int").alias("x"))
    place = lambda c, n, m: F.least(F.greatest((F.col(c) + 0.5) * n / m - 0.5, _f(0)), _f(n - 1))
    grid = grid.select("y", "x", place("y", height, new_height).alias("sy"), place("x", width, new_width).alias("sx"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    grid = grid.withColumn("k", corner)
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    weight = F.when(F.col("k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("k.b") == 1, fx).otherwise(1 - fx)
    grid = grid.select(F.col("y").alias("oy"), F.col("x").alias("ox"), weight.alias("w"), F.least(F.floor("sy") + F.col("k.a"), F.lit(height - 1)).cast("int").alias("y"), F.least(F.floor("sx") + F.col("k.b"), F.lit(width - 1)).cast("int").alias("x"))
    hit = image.join(F.broadcast(grid), ["y", "x"])  # a grid of fixed size
    return hit.groupBy(key, "c", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def binarize(image: DataFrame, threshold: float) -> DataFrame:
    return image.where(F.col("v") >= threshold)


def region_scores(probability: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """key, score: the mean of probability(key, y, x, v) over the pixels inside polygons(key, p)."""
    from foliolens.functions.geometry import contains

    hit = probability.join(polygons, key).where(contains(F.col("p"), F.col("x").cast("double"), F.col("y").cast("double")))
    return hit.groupBy(key).agg(F.avg("v").alias("score"))


def levels(edges: DataFrame, rounds: int) -> DataFrame:
    """node, level: the longest way from a source of a graph edges(a, b) without cycles, by ``rounds`` relaxations."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("level", F.lit(0))
    for _ in range(rounds):
        longer = nodes.join(edges, nodes["node"] == edges["a"]).select(F.col("b").alias("node"), (F.col("level") + 1).alias("level"))
        nodes = nodes.unionByName(longer).groupBy("node").agg(F.max("level").alias("level"))
    return nodes
