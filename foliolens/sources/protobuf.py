"""Protocol-buffer wire format: a reader that yields fields, and a writer for files made in tests and tools."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

VARINT, FIXED64, BYTES, GROUP, END_GROUP, FIXED32 = range(6)
MOST_VARINT_BYTES = 10


class WireError(ValueError):
    """Truncated or malformed input."""


def varint(buf: memoryview, at: int) -> tuple[int, int]:
    """Value and the place behind it."""
    value = 0
    for i in range(MOST_VARINT_BYTES):
        if at + i >= len(buf):
            raise WireError("truncated varint")
        b = buf[at + i]
        value |= (b & 127) << (7 * i)
        if b < 128:
            if value >> 64:
                raise WireError("varint over 64 bits")
            return value, at + i + 1
    raise WireError("malformed varint")


def signed64(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field number, wire type, value): integers for numbers, a view for bytes; deprecated groups are skipped."""
    buf, at = memoryview(data), 0
    while at < len(buf):
        tag, at = varint(buf, at)
        number, kind = tag >> 3, tag & 7
        if not 0 < number < 1 << 29:
            raise WireError(f"field number {number}")
        if kind == GROUP:
            at = _end_of_group(buf, at, number)
            continue
        value, at = _value(buf, at, kind)
        yield number, kind, value


def _value(buf: memoryview, at: int, kind: int) -> tuple[int | memoryview, int]:
    if kind == VARINT:
        return varint(buf, at)
    if kind == BYTES:
        size, at = varint(buf, at)
    elif kind in (FIXED32, FIXED64):
        size = 4 if kind == FIXED32 else 8
    else:
        raise WireError(f"wire type {kind}")
    if at + size > len(buf):
        raise WireError("truncated field")
    part = buf[at : at + size]
    return (part if kind == BYTES else int.from_bytes(part, "little")), at + size


def _end_of_group(buf: memoryview, at: int, number: int) -> int:
    while True:
        tag, at = varint(buf, at)
        if tag & 7 == END_GROUP:
            if tag >> 3 != number:
                raise WireError("group ends with another number")
            return at
        at = _end_of_group(buf, at, tag >> 3) if tag & 7 == GROUP else _value(buf, at, tag & 7)[1]


def numbers(kind: int, value: int | memoryview, dtype: str) -> list | np.ndarray:
    """The elements of a repeated numeric field, packed or not. dtype is int64, float32 or float64."""
    if dtype == "int64":
        if kind == VARINT:
            return [signed64(value)]
        out, at = [], 0
        while at < len(value):
            v, at = varint(value, at)
            out.append(signed64(v))
        return out
    if kind != BYTES:
        return [struct.unpack("<f" if dtype == "float32" else "<d", value.to_bytes(4 if dtype == "float32" else 8, "little"))[0]]
    size = np.dtype(dtype).itemsize
    if len(value) % size:
        raise WireError("packed field of odd length")
    return np.frombuffer(value, np.dtype(dtype).newbyteorder("<"))


class Writer:
    def __init__(self):
        self.out = bytearray()

    def varint(self, v: int) -> Writer:
        v &= (1 << 64) - 1
        while v > 127:
            self.out.append(v & 127 | 128)
            v >>= 7
        self.out.append(v)
        return self

    def tag(self, number: int, kind: int) -> Writer:
        return self.varint(number << 3 | kind)

    def integer(self, number: int, v: int) -> Writer:
        return self.tag(number, VARINT).varint(v)

    def float32(self, number: int, v: float) -> Writer:
        self.tag(number, FIXED32).out += struct.pack("<f", v)
        return self

    def bytes(self, number: int, v: bytes | str | Writer) -> Writer:
        v = v.encode() if isinstance(v, str) else bytes(v.out) if isinstance(v, Writer) else v
        self.tag(number, BYTES).varint(len(v)).out += v
        return self

    def packed_integers(self, number: int, values: list[int]) -> Writer:
        inner = Writer()
        for v in values:
            inner.varint(v)
        return self.bytes(number, inner)

    def packed_floats(self, number: int, values: list[float]) -> Writer:
        return self.bytes(number, np.asarray(values, "<f4").tobytes())
