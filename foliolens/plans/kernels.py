"""NumPy kernels of the tensor operators, float32 in and out. Arrays are [N, C, H, W] where they are images."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

Pair = tuple[int, int]
F32 = np.float32


class ShapeError(ValueError):
    pass


def conv_size(n: int, kernel: int, stride: int, pad: int, dilation: int) -> int:
    """Output length of a convolution; the division truncates toward zero."""
    return int((n + 2 * pad - (dilation * (kernel - 1) + 1)) / stride) + 1


def transposed_size(n: int, kernel: int, stride: int, pad: int, dilation: int) -> int:
    return (n - 1) * stride - 2 * pad + dilation * (kernel - 1) + 1


def windows(x: np.ndarray, kernel: Pair, stride: Pair, pad: Pair, dilation: Pair = (1, 1), fill: float = 0.0) -> np.ndarray:
    """[N, C, OH, OW, KH, KW] view of the patches of a padded image."""
    if any(pad):
        x = np.pad(x, ((0, 0), (0, 0), (pad[0], pad[0]), (pad[1], pad[1])), constant_values=F32(fill))
    reach = [d * (k - 1) + 1 for k, d in zip(kernel, dilation, strict=True)]
    if x.shape[2] < reach[0] or x.shape[3] < reach[1]:
        raise ShapeError(f"kernel {kernel} is larger than the padded image {x.shape[2:]}")
    view = sliding_window_view(x, reach, axis=(2, 3))
    return view[:, :, :: stride[0], :: stride[1], :: dilation[0], :: dilation[1]]


def im2col(x: np.ndarray, kernel: Pair, stride: Pair, pad: Pair, dilation: Pair = (1, 1)) -> np.ndarray:
    """[N, C * KH * KW, OH * OW] patch matrix."""
    w = windows(x, kernel, stride, pad, dilation)
    n, c, oh, ow, kh, kw = w.shape
    return np.ascontiguousarray(w.transpose(0, 1, 4, 5, 2, 3)).reshape(n, c * kh * kw, oh * ow)


def conv(x: np.ndarray, w: np.ndarray, bias: np.ndarray | None = None, stride: Pair = (1, 1), pad: Pair = (0, 0), dilation: Pair = (1, 1), groups: int = 1) -> np.ndarray:
    """Weights [OutC, C / groups, KH, KW]. A depthwise convolution skips the patch matrix."""
    out_c, per_group, kh, kw = w.shape
    if x.shape[1] != per_group * groups or out_c % groups:
        raise ShapeError(f"{x.shape[1]} channels, {groups} groups, weights {w.shape}")
    if groups == x.shape[1] == out_c:
        y = np.einsum("ncijkl,ckl->ncij", windows(x, (kh, kw), stride, pad, dilation), w[:, 0], optimize=True)
    else:
        parts = []
        for g in range(groups):
            cols = im2col(x[:, g * per_group : (g + 1) * per_group], (kh, kw), stride, pad, dilation)
            parts.append(w[g * out_c // groups : (g + 1) * out_c // groups].reshape(out_c // groups, -1) @ cols)
        size = [conv_size(x.shape[2 + i], (kh, kw)[i], stride[i], pad[i], dilation[i]) for i in (0, 1)]
        y = (np.concatenate(parts, axis=1) if groups > 1 else parts[0]).reshape(x.shape[0], out_c, *size)
    if bias is not None:
        y += bias[:, None, None]
    return y.astype(F32, copy=False)


def conv_transpose(x: np.ndarray, w: np.ndarray, bias: np.ndarray | None = None, stride: Pair = (1, 1), pad: Pair = (0, 0), dilation: Pair = (1, 1), groups: int = 1) -> np.ndarray:
    """Weights [InC, OutC / groups, KH, KW]: every pixel spreads its kernel over the output."""
    n, c, h, wd = x.shape
    in_c, per_group, kh, kw = w.shape
    if c != in_c or c % groups:
        raise ShapeError(f"{c} channels, {groups} groups, weights {w.shape}")
    size = [transposed_size((h, wd)[i], (kh, kw)[i], stride[i], pad[i], dilation[i]) for i in (0, 1)]
    full = np.zeros((n, per_group * groups, size[0] + 2 * pad[0], size[1] + 2 * pad[1]), F32)
    step = c // groups
    for g in range(groups):
        spread = np.einsum("nchw,cokl->noklhw", x[:, g * step : (g + 1) * step], w[g * step : (g + 1) * step], optimize=True)
        for k in range(kh):
            for j in range(kw):
                at = full[:, g * per_group : (g + 1) * per_group, k * dilation[0] :, j * dilation[1] :]
                at[:, :, : (h - 1) * stride[0] + 1 : stride[0], : (wd - 1) * stride[1] + 1 : stride[1]] += spread[:, :, k, j]
    y = full[:, :, pad[0] : pad[0] + size[0], pad[1] : pad[1] + size[1]]
    return (y if bias is None else y + bias[:, None, None]).astype(F32)


def batch_norm_terms(gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, variance: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """scale and shift of y = x * scale + shift."""
    if (variance + epsilon <= 0).any():
        raise ShapeError("variance plus epsilon must be positive")
    scale = gamma / np.sqrt(variance + epsilon)
    return scale.astype(F32), (beta - mean * scale).astype(F32)


def fold_batch_norm(w: np.ndarray, bias: np.ndarray | None, scale: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a convolution followed by a batch normalisation, as one convolution."""
    own = np.zeros(len(w), F32) if bias is None else bias
    return (w * scale[:, None, None, None]).astype(F32), (own * scale + shift).astype(F32)


def per_channel(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A vector by channel, shaped for an array of rank 2 or 4."""
    return v.reshape(1, -1, *[1] * (x.ndim - 2))


def max_pool(x: np.ndarray, kernel: Pair, stride: Pair, pad: Pair) -> np.ndarray:
    return windows(x, kernel, stride, pad, fill=-np.inf).max(axis=(4, 5)).astype(F32)


def average_pool(x: np.ndarray, kernel: Pair, stride: Pair, pad: Pair, count_padding: bool = False) -> np.ndarray:
    total = windows(x, kernel, stride, pad).sum(axis=(4, 5))
    if count_padding:
        return (total / F32(kernel[0] * kernel[1])).astype(F32)
    count = windows(np.ones((1, 1, *x.shape[2:]), F32), kernel, stride, pad).sum(axis=(4, 5))
    return np.divide(total, count, out=np.zeros_like(total), where=count > 0).astype(F32)


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return (e / e.sum(axis=axis, keepdims=True)).astype(F32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.negative(x, dtype=np.float64)
    with np.errstate(over="ignore"):
        np.exp(e, out=e)
    e += 1
    return np.divide(1, e, out=e).astype(F32)


#: How an output coordinate maps to the input: (coordinate, scale, input size, output size) -> coordinate.
COORDINATES: dict[str, Callable[[np.ndarray, float, int, int], np.ndarray]] = {
    "half_pixel": lambda c, s, i, o: (c + 0.5) / s - 0.5,
    "asymmetric": lambda c, s, i, o: c / s,
    "pytorch_half_pixel": lambda c, s, i, o: (c + 0.5) / s - 0.5 if o > 1 else c * 0.0,
    "align_corners": lambda c, s, i, o: c * (i - 1) / (o - 1) if o > 1 else c * 0.0,
}
#: How a coordinate becomes the index of its nearest neighbour.
NEAREST: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "round_prefer_floor": lambda c: np.ceil(c - 0.5), "round_prefer_ceil": lambda c: np.floor(c + 0.5), "floor": np.floor, "ceil": np.ceil,
}


def resize(x: np.ndarray, scales: Pair | tuple[float, float], sizes: Pair | None = None, mode: str = "nearest", coordinates: str = "half_pixel", nearest: str = "round_prefer_floor") -> np.ndarray:
    """Height and width by scales (output size is the floor) or to sizes."""
    out = x
    for axis in (2, 3):
        n = x.shape[axis]
        m = sizes[axis - 2] if sizes else int(np.floor(n * scales[axis - 2]))
        c = COORDINATES[coordinates](np.arange(m, dtype=np.float64), m / n if sizes else float(scales[axis - 2]), n, m)
        if mode == "nearest":
            out = np.take(out, np.clip(NEAREST[nearest](c), 0, n - 1).astype(int), axis=axis)
        else:
            c = np.clip(c, 0, n - 1)
            low = np.floor(c).astype(int)
            t = (c - low).astype(F32).reshape([-1 if a == axis else 1 for a in range(4)])
            out = np.take(out, low, axis=axis) * (1 - t) + np.take(out, np.minimum(low + 1, n - 1), axis=axis) * t
    return out.astype(F32)
