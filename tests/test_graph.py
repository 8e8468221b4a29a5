"""Model files, planning and the tensor operators, against onnxruntime on models that our own writer makes."""

import numpy as np
import onnxruntime as ort
import pytest

from foliolens.plans import graph as G
from foliolens.plans import kernels as K
from foliolens.sources import onnx as O
from foliolens.sources.protobuf import WireError, Writer, fields, numbers, zigzag

R = np.random.default_rng(42)
X = R.normal(size=(2, 4, 9, 11)).astype("f4")


def f(*shape):
    return R.normal(size=shape).astype("f4")


def node(op, n_in, out="y", **attributes):
    return O.Node(op, n_in if isinstance(n_in, list) else ["x"], [out], op, "", attributes)


I64 = lambda *v: np.array(v, np.int64)
CASES = {
    "conv": ([node("Conv", ["x", "w", "b"], strides=[2, 1], pads=[1, 2, 1, 2], kernel_shape=[3, 3])], {"w": f(6, 4, 3, 3), "b": f(6)}),
    "conv_groups": ([node("Conv", ["x", "w"], group=2, dilations=[2, 1])], {"w": f(6, 2, 3, 3)}),
    "depthwise": ([node("Conv", ["x", "w"], group=4, pads=[1, 1, 1, 1])], {"w": f(4, 1, 3, 3)}),
    "conv_transpose": ([node("ConvTranspose", ["x", "w", "b"], strides=[2, 2], pads=[1, 0, 1, 0], group=2)], {"w": f(4, 3, 3, 2), "b": f(6)}),
    "batch_norm": ([node("BatchNormalization", ["x", "g", "h", "m", "v"])], {"g": f(4), "h": f(4), "m": f(4), "v": np.abs(f(4))}),
    "prelu": ([node("PRelu", ["x", "s"])], {"s": f(4, 1, 1)}),
    "gemm": ([node("Flatten", ["x"], "t"), node("Gemm", ["t", "w", "b"], transB=1)], {"w": f(5, 396), "b": f(5)}),
    "matmul": ([node("MatMul", ["x", "w"])], {"w": f(11, 3)}),
    "resize_nearest": ([node("Resize", ["x", "", "s"], mode="nearest", coordinate_transformation_mode="asymmetric", nearest_mode="floor")], {"s": np.array([1, 1, 2, 1.5], "f4")}),
    "resize_linear": ([node("Resize", ["x", "", "s"], mode="linear")], {"s": np.array([1, 1, 2, 0.5], "f4")}),
    "resize_sizes": ([node("Resize", ["x", "", "", "z"], mode="linear", coordinate_transformation_mode="align_corners")], {"z": I64(2, 4, 5, 20)}),
    "global_pool": ([node("GlobalAveragePool", ["x"])], {}),
    "max_pool": ([node("MaxPool", ["x"], kernel_shape=[3, 2], strides=[2, 2], pads=[1, 0, 1, 0])], {}),
    "average_pool": ([node("AveragePool", ["x"], kernel_shape=[2, 3], strides=[2, 3], pads=[1, 1, 1, 1])], {}),
    "average_pool_padding": ([node("AveragePool", ["x"], kernel_shape=[2, 3], strides=[1, 1], pads=[1, 1, 1, 1], count_include_pad=1)], {}),
    "relu": ([node("Relu", ["x"])], {}), "leaky": ([node("LeakyRelu", ["x"], alpha=0.2)], {}), "sigmoid": ([node("Sigmoid", ["x"])], {}), "tanh": ([node("Tanh", ["x"])], {}),
    "clip": ([node("Clip", ["x", "a", "b"])], {"a": np.array(-0.5, "f4"), "b": np.array(0.7, "f4")}),
    "hard_sigmoid": ([node("HardSigmoid", ["x"], alpha=0.3)], {}), "hard_swish": ([node("HardSwish", ["x"])], {}), "softmax": ([node("Softmax", ["x"], axis=1)], {}),
    **{op: ([node(op, ["x", "w"])], {"w": np.abs(f(4, 1, 11)) + 0.5}) for op in ("Add", "Sub", "Mul", "Div")},
    "pow": ([node("Relu", ["x"], "t"), node("Pow", ["t", "w"])], {"w": np.array(2.5, "f4")}), "sqrt": ([node("Relu", ["x"], "t"), node("Sqrt", ["t"])], {}),
    "reduce_mean": ([node("ReduceMean", ["x"], axes=[1, 3], keepdims=0)], {}), "flatten": ([node("Flatten", ["x"], axis=2)], {}),
    "reshape": ([node("Reshape", ["x", "s"])], {"s": I64(0, -1, 11)}), "transpose": ([node("Transpose", ["x"], perm=[0, 2, 3, 1])], {}), "concat": ([node("Concat", ["x", "x"], axis=1)], {}),
    "unsqueeze": ([node("Unsqueeze", ["x", "a"])], {"a": I64(0, -1)}), "squeeze": ([node("GlobalAveragePool", ["x"], "t"), node("Squeeze", ["t", "a"])], {"a": I64(2, 3)}),
    "slice": ([node("Slice", ["x", "s", "e", "a", "p"])], {"s": I64(-1, 1), "e": I64(-100, 100), "a": I64(3, 1), "p": I64(-2, 1)}),
    "identity": ([node("Identity", ["x"], "t"), node("Dropout", ["t"])], {}), "constant": ([O.Node("Constant", [], ["k"], "k", "", {"value": f(11)}), node("Add", ["x", "k"])], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_operators_match_an_independent_runtime(name):
    nodes, weights = CASES[name]
    data = O.model_bytes(nodes, {"x": list(X.shape)}, ["y"], weights, 14 if name == "hard_swish" else 13)
    options = ort.SessionOptions()
    options.log_severity_level = 4
    want = ort.InferenceSession(data, options).run(None, {"x": X})[0]
    got = G.plan(O.parse(data)).run(x=X)["y"]
    assert got.shape == want.shape
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)


def run(nodes, x=X, opset=13, fold=False, **weights):
    return G.plan(O.parse(O.model_bytes(nodes, {"x": list(x.shape)}, ["y"], weights, opset)), fold).run(x=x)["y"]


def test_shape_values_and_folding():
    np.testing.assert_array_equal(run([node("Shape", ["x"], start=1)]), [4, 9, 11])
    weights = {"w": f(6, 4, 3, 3), "g": f(6), "h": f(6), "m": f(6), "v": np.abs(f(6))}
    chain = [node("Conv", ["x", "w"], "t"), node("BatchNormalization", ["t", "g", "h", "m", "v"])]
    np.testing.assert_allclose(run(chain, **weights), run(chain, fold=True, **weights), rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize(
    ("nodes", "weights"),
    [
        ([node("Nonsense", ["x"])], {}), ([node("Conv", ["x", "x"])], {}), ([node("MaxPool", ["x"], kernel_shape=[2, 2], ceil_mode=1)], {}), ([node("Softmax", ["z"])], {}),
        ([node("Conv", ["x", "w"], pads=[1, 0, 0, 0])], {"w": f(1, 4, 2, 2)}), ([node("Conv", ["x", "w"], auto_pad="SAME_UPPER")], {"w": f(1, 4, 2, 2)}), ([node("Gemm", ["x", "w"], alpha=2.0)], {"w": f(3, 3)}),
        ([node("Relu", ["t"], "y"), node("Relu", ["y"], "t")], {}), ([node("Relu", ["x"]), node("Tanh", ["x"])], {}), ([node("Clip", ["x", "a", "b"])], {"a": np.array(1, "f4"), "b": np.array(0, "f4")}),
        ([node("Resize", ["x", "", "s"], mode="cubic")], {"s": np.array([1, 1, 2, 2], "f4")}), ([node("ReduceMean", ["x", "a"])], {"a": I64(1)}), ([node("Concat", ["x", "x"])], {}),
    ],
)
def test_refusals(nodes, weights):
    with pytest.raises(O.ModelError):
        run(nodes, **weights)


def test_order_and_files(tmp_path):
    nodes = [node("Relu", ["t"]), node("Tanh", ["x"], "t")]
    data = O.model_bytes(nodes, {"x": ["n", 3]}, ["y"])
    plan = G.plan(O.parse(data))
    assert [s[4].split("(")[0] for s in plan.steps] == ["Tanh", "Relu"] and "2 operators" in str(plan)
    (tmp_path / "m.onnx").write_bytes(data)
    model, digest = O.load(str(tmp_path / "m.onnx"))
    assert model.opset == 13 and digest.startswith("sha256:") and model.graph.inputs[0].shape == ["n", 3]
    for cut in range(0, len(data), 3):
        try:
            O.parse(data[:cut])
        except (WireError, O.ModelError):
            pass


def test_wire_and_tensors():
    w = Writer().integer(1, -5).float32(2, 1.5).packed_integers(3, [1, -1]).bytes(4, "a")
    got = {n: (k, v) for n, k, v in fields(bytes(w.out))}
    assert numbers(*got[1], "int64") == [-5] and numbers(*got[2], "float32") == [1.5] and numbers(*got[3], "int64") == [1, -1] and zigzag(3) == -2
    for bad in (b"\x08", b"\x08" + b"\xff" * 11, b"\x0a\x05a", b"\x07"):
        with pytest.raises(WireError):
            list(fields(bad))
    for kind in ("float16", "int8", "uint16", "float64", "int64", "bool"):
        a = np.array([[0, 1, 1]], kind)
        np.testing.assert_array_equal(O._tensor(memoryview(bytes(O.tensor_bytes("t", a).out))).floats(), a.astype("f4"))
    assert K.conv_size(5, 3, 2, 1, 1) == 3 and K.transposed_size(3, 3, 2, 1, 1) == 5 and G.step_count(4, -1, -2) == 3


def test_graph_in_tasks(spark):
    plan = G.plan(O.parse(O.model_bytes([node("MatMul", ["x", "w"])], {"x": [2, 3]}, ["y"], {"w": np.eye(3, 2, dtype="f4")})))
    df = spark.createDataFrame([(1, [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "id long, shape array<int>, data array<float>")
    r = G.run_on(df, plan).collect()[0]
    assert (r["shape"], r["data"]) == ([2, 2], [1.0, 2.0, 4.0, 5.0])
