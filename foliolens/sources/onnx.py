"""ONNX model files as dataclasses, and as DataFrames for inspection. Field numbers are those of the public format."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from foliolens.sources.protobuf import BYTES, FIXED32, Writer, fields, numbers, signed64

LARGEST_MODEL = 2 << 30
#: Element types by number.
ELEMENT_TYPES = {
    1: "float32", 2: "uint8", 3: "int8", 4: "uint16", 5: "int16", 6: "int32", 7: "int64", 8: "string", 9: "bool", 10: "float16", 11: "float64", 12: "uint32", 13: "uint64", 14: "complex64", 15: "complex128", 16: "bfloat16",
}
_ATTRIBUTE_KINDS = {1: "f", 2: "i", 3: "s", 4: "t", 5: "g", 6: "floats", 7: "ints", 8: "strings", 9: "tensors"}


class ModelError(ValueError):
    pass


@dataclass
class Tensor:
    name: str = ""
    dims: list[int] = field(default_factory=list)
    element: int = 0
    float_data: list[float] = field(default_factory=list)
    int32_data: list[int] = field(default_factory=list)
    int64_data: list[int] = field(default_factory=list)
    double_data: list[float] = field(default_factory=list)
    uint64_data: list[int] = field(default_factory=list)
    raw: bytes = b""
    external: bool = False

    @property
    def count(self) -> int:
        return int(np.prod(self.dims, dtype=np.int64)) if self.dims else 1

    def _raw(self) -> np.ndarray:
        kind = ELEMENT_TYPES.get(self.element)
        if kind in (None, "string", "complex64", "complex128"):
            raise ModelError(f"tensor {self.name!r}: element type {kind or self.element} cannot be converted")
        if kind == "bfloat16":
            return (np.frombuffer(self.raw, "<u2").astype("<u4") << 16).view("<f4")
        return np.frombuffer(self.raw, "u1" if kind == "bool" else np.dtype(kind).newbyteorder("<"))

    def _checked(self, values: Any, kind: str) -> np.ndarray:
        if len(values) != self.count:
            raise ModelError(f"tensor {self.name!r}: {len(values)} values for shape {self.dims}")
        return np.asarray(values).astype(kind).reshape(self.dims)

    def floats(self) -> np.ndarray:
        """Any stored numbers as float32, in the tensor's shape."""
        if self.external:
            raise ModelError(f"tensor {self.name!r} is stored in another file")
        for values in (self.float_data, self.int64_data, self.int32_data, self.double_data, self.uint64_data):
            if len(values):
                if values is self.int32_data and ELEMENT_TYPES.get(self.element) in ("float16", "bfloat16"):
                    halves = np.asarray(values, np.uint16)
                    values = halves.view(np.float16) if self.element == 10 else (halves.astype("<u4") << 16).view("<f4")
                return self._checked(values, "float32")
        return self._checked(self._raw() if self.raw else [], "float32")

    def ints(self) -> np.ndarray:
        """Stored int64 or int32 as int64; other types are an error."""
        if self.external:
            raise ModelError(f"tensor {self.name!r} is stored in another file")
        if ELEMENT_TYPES.get(self.element) not in ("int64", "int32"):
            raise ModelError(f"tensor {self.name!r} is not of whole numbers")
        return self._checked(self.int64_data or self.int32_data or (self._raw() if self.raw else []), "int64")


@dataclass
class Node:
    op: str = ""
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    name: str = ""
    domain: str = ""
    attributes: dict[str, Any] = field(default_factory=dict)

    def __str__(self) -> str:
        return f"{self.op}({', '.join(self.inputs)}) -> {', '.join(self.outputs)}"

    def get(self, name: str, default: Any = None) -> Any:
        return self.attributes.get(name, default)


@dataclass
class Value:
    name: str = ""
    element: int = 0
    shape: list[int | str] = field(default_factory=list)


@dataclass
class Graph:
    name: str = ""
    nodes: list[Node] = field(default_factory=list)
    initializers: dict[str, Tensor] = field(default_factory=dict)
    inputs: list[Value] = field(default_factory=list)
    outputs: list[Value] = field(default_factory=list)
    values: list[Value] = field(default_factory=list)


@dataclass
class Model:
    graph: Graph
    opsets: dict[str, int]
    ir_version: int = 0
    producer: str = ""

    @property
    def opset(self) -> int:
        """Version of the default domain, 0 if absent."""
        return self.opsets.get("", self.opsets.get("ai.onnx", 0))


def _text(v: memoryview) -> str:
    return bytes(v).decode("utf-8", "replace")


def _tensor(data: memoryview) -> Tensor:
    t = Tensor()
    repeated = {1: ("dims", "int64"), 4: ("float_data", "float32"), 5: ("int32_data", "int64"), 7: ("int64_data", "int64"), 10: ("double_data", "float64"), 11: ("uint64_data", "int64")}
    for number, kind, v in fields(data):
        if number in repeated:
            name, dtype = repeated[number]
            getattr(t, name).extend(numbers(kind, v, dtype))
        elif number == 2:
            t.element = v
        elif number == 8:
            t.name = _text(v)
        elif number == 9:
            t.raw = bytes(v)
        elif number == 14:
            t.external = v == 1
    t.uint64_data = [x & 0xFFFFFFFFFFFFFFFF for x in t.uint64_data]
    return t


def _attribute(data: memoryview) -> tuple[str, Any]:
    name, declared, found = "", 0, {"floats": [], "ints": [], "strings": [], "tensors": []}
    for number, kind, v in fields(data):
        if number == 1:
            name = _text(v)
        elif number == 2 and kind == FIXED32:
            found["f"] = float(numbers(kind, v, "float32")[0])
        elif number == 3:
            found["i"] = signed64(v)
        elif number == 4:
            found["s"] = bytes(v)
        elif number == 5:
            found["t"] = _tensor(v)
        elif number == 6:
            found["g"] = _graph(v)
        elif number == 7:
            found["floats"].extend(float(x) for x in numbers(kind, v, "float32"))
        elif number == 8:
            found["ints"].extend(numbers(kind, v, "int64"))
        elif number == 9:
            found["strings"].append(bytes(v))
        elif number == 10:
            found["tensors"].append(_tensor(v))
        elif number == 20:
            declared = v
    if declared in _ATTRIBUTE_KINDS:
        empty = {1: 0.0, 2: 0, 3: b""}.get(declared)
        return name, found.get(_ATTRIBUTE_KINDS[declared], empty)
    return name, next((found[k] for k in ("f", "i", "s", "t", "g", "floats", "ints", "strings", "tensors") if found.get(k) not in (None, [])), None)


def _node(data: memoryview) -> Node:
    n = Node()
    for number, _, v in fields(data):
        if number == 1:
            n.inputs.append(_text(v))
        elif number == 2:
            n.outputs.append(_text(v))
        elif number in (3, 4, 7):
            setattr(n, {3: "name", 4: "op", 7: "domain"}[number], _text(v))
        elif number == 5:
            key, value = _attribute(v)
            n.attributes[key] = value
    return n


def _value(data: memoryview) -> Value:
    out = Value()
    for number, _, v in fields(data):
        if number == 1:
            out.name = _text(v)
        elif number == 2:
            for n1, _, tensor_type in fields(v):
                if n1 != 1:
                    continue
                for n2, _, part in fields(tensor_type):
                    if n2 == 1:
                        out.element = part
                    elif n2 == 2:
                        out.shape = [_dimension(d) for n3, _, d in fields(part) if n3 == 1]
    return out


def _dimension(data: memoryview) -> int | str:
    for number, _, v in fields(data):
        return signed64(v) if number == 1 else _text(v)
    return "?"


def _graph(data: memoryview) -> Graph:
    g = Graph()
    for number, _, v in fields(data):
        if number == 1:
            g.nodes.append(_node(v))
        elif number == 2:
            g.name = _text(v)
        elif number == 5:
            t = _tensor(v)
            g.initializers[t.name] = t
        elif number in (11, 12, 13):
            {11: g.inputs, 12: g.outputs, 13: g.values}[number].append(_value(v))
    return g


def parse(data: bytes) -> Model:
    """A model from its bytes; unknown fields are skipped, and a graph must be there."""
    if len(data) > LARGEST_MODEL:
        raise ModelError("model over 2 GiB")
    graph, opsets, version, producer = None, {}, 0, ""
    for number, kind, v in fields(data):
        if number == 1:
            version = v
        elif number == 2 and kind == BYTES:
            producer = _text(v)
        elif number == 7 and kind == BYTES:
            graph = _graph(v)
        elif number == 8 and kind == BYTES:
            got = {n: x for n, _, x in fields(v)}
            opsets[_text(got[1]) if 1 in got else ""] = got.get(2, 0)
    if graph is None:
        raise ModelError("no graph in the model")
    return Model(graph, opsets, version, producer)


def load(path: str) -> tuple[Model, str]:
    """A model file of the driver, and its sha256 with a prefix; the size is checked before it is read."""
    if os.path.getsize(path) > LARGEST_MODEL:
        raise ModelError("model over 2 GiB")
    with open(path, "rb") as f:
        data = f.read()
    return parse(data), f"sha256:{hashlib.sha256(data).hexdigest()}"


def node_frame(spark: SparkSession, model: Model) -> DataFrame:
    """The graph as a relation: position, op, name, inputs and outputs of each node."""
    rows = [(i, n.op, n.name, n.domain, n.inputs, n.outputs) for i, n in enumerate(model.graph.nodes)]
    return spark.createDataFrame(rows, "position int, op string, name string, domain string, inputs array<string>, outputs array<string>")


# ---- writing

def tensor_bytes(name: str, a: np.ndarray) -> Writer:
    element = next(k for k, v in ELEMENT_TYPES.items() if v == a.dtype.name)
    w = Writer().packed_integers(1, list(a.shape)).integer(2, element).bytes(8, name)
    return w.bytes(9, np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes())


def _attribute_bytes(name: str, v: Any) -> Writer:
    w = Writer().bytes(1, name)
    if isinstance(v, float):
        return w.float32(2, v).integer(20, 1)
    if isinstance(v, (bool, int)):
        return w.integer(3, int(v)).integer(20, 2)
    if isinstance(v, (str, bytes)):
        return w.bytes(4, v).integer(20, 3)
    if isinstance(v, np.ndarray):
        return w.bytes(5, tensor_bytes("", v)).integer(20, 4)
    if v and isinstance(v[0], float):
        return w.packed_floats(7, v).integer(20, 6)
    for x in v:
        w.integer(8, x)
    return w.integer(20, 7)


def model_bytes(nodes: list[Node], inputs: dict[str, list[int | str]], outputs: list[str], weights: dict[str, np.ndarray] | None = None, opset: int = 13) -> bytes:
    """A model file of the given nodes, with float32 inputs and outputs."""
    g = Writer()
    for n in nodes:
        w = Writer()
        for x in n.inputs:
            w.bytes(1, x)
        for x in n.outputs:
            w.bytes(2, x)
        w.bytes(3, n.name).bytes(4, n.op)
        for k, v in n.attributes.items():
            w.bytes(5, _attribute_bytes(k, v))
        if n.domain:
            w.bytes(7, n.domain)
        g.bytes(1, w)
    g.bytes(2, "graph")
    for k, v in (weights or {}).items():
        g.bytes(5, tensor_bytes(k, v))
    for number, named in ((11, inputs), (12, {o: None for o in outputs})):
        for k, shape in named.items():
            kind = Writer().integer(1, 1)
            if shape is not None:
                dims = Writer()
                for d in shape:
                    dims.bytes(1, Writer().bytes(2, d) if isinstance(d, str) else Writer().integer(1, d))
                kind.bytes(2, dims)
            g.bytes(number, Writer().bytes(1, k).bytes(2, Writer().bytes(1, kind)))
    return bytes(Writer().integer(1, 8).bytes(7, g).bytes(8, Writer().bytes(1, "").integer(2, opset)).out)
