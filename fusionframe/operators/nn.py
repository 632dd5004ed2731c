"""The descriptor network's forward pass with given weights, and solver steps over a weight table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conv3d(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cross-correlation without padding: x (n, c, d, h, w), w (out, c, k, k, k)."""
    view = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3, 4))
    return np.einsum("ncdhwijk,ocijk->nodhw", view, w, optimize=True) + b[None, :, None, None, None]


def max_pool(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Output sizes are rounded up; windows at the end are cut."""
    n = [-(-(d - size) // stride) + 1 for d in x.shape[2:]]
    pad = [(0, 0), (0, 0), *[(0, max(0, (m - 1) * stride + size - d)) for m, d in zip(n, x.shape[2:], strict=True)]]
    x = np.pad(x, pad, constant_values=-np.inf)
    view = np.lib.stride_tricks.sliding_window_view(x, (size,) * 3, axis=(2, 3, 4))[:, :, ::stride, ::stride, ::stride]
    return view.max((5, 6, 7))


Layer = tuple  # ("conv", w, b) | ("relu",) | ("pool", size, stride) | ("dense", w, b) | ("softmax",)


def forward(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for kind, *p in layers:
        if kind == "conv":
            x = conv3d(x, *p)
        elif kind == "relu":
            x = np.maximum(x, 0)
        elif kind == "pool":
            x = max_pool(x, *p)
        elif kind == "dense":
            x = x.reshape(len(x), -1) @ p[0].T + p[1]
        elif kind == "softmax":
            e = np.exp(x - x.max(1, keepdims=True))
            x = e / e.sum(1, keepdims=True)
        else:
            raise ValueError(f"unknown layer {kind}")
    return x


def describe(patches: DataFrame, layers: list[Layer], side: int, key: str = "kp", patch: str = "patch", batch: int = 50) -> DataFrame:
    """key, desc array<float> of cubic patches; every patch is described, also those of the last, smaller batch."""
    shared = patches.sparkSession.sparkContext.broadcast(layers)
    types = pa.schema([("k", pa.int64()), ("desc", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = np.array(part.column(1).to_pylist(), np.float32).reshape(-1, 1, side, side, side)
                y = forward(shared.value, x).reshape(len(x), -1)
                yield pa.RecordBatch.from_pydict({"k": part.column(0), "desc": list(y.astype(np.float32))}, schema=types)

    return patches.select(F.col(key).cast("long").alias("k"), patch).mapInArrow(run, "k bigint, desc array<float>").withColumnRenamed("k", key)


def solver_step(weights: DataFrame, kind: str, lr: float, momentum: float = 0.9, decay: float = 0.0, momentum2: float = 0.999, delta: float = 1e-8, t: int = 1, l1: bool = False) -> DataFrame:
    """weights (name, w, g, h, h2) after one step: w, and the solver's history h and h2."""
    w, g0, h, h2 = (F.col(c) for c in ("w", "g", "h", "h2"))
    g: Column = g0 + decay * (F.signum(w) if l1 else w)
    if kind == "sgd":
        h1, step = momentum * h + lr * g, None
        return weights.withColumns({"h": h1, "w": w - h1})
    if kind == "nag":
        h1 = momentum * h + lr * g
        return weights.withColumns({"h": h1, "w": w - ((1 + momentum) * h1 - momentum * h)})
    if kind == "adagrad":
        h1 = h + g * g
        return weights.withColumns({"h": h1, "w": w - lr * g / (F.sqrt(h1) + delta)})
    if kind == "rmsprop":
        h1 = momentum * h + (1 - momentum) * g * g
        return weights.withColumns({"h": h1, "w": w - lr * g / (F.sqrt(h1) + delta)})
    if kind == "adadelta":
        h1 = momentum * h + (1 - momentum) * g * g
        step = g * F.sqrt((h2 + delta) / (h1 + delta))
        return weights.withColumns({"h": h1, "h2": momentum * h2 + (1 - momentum) * step * step, "w": w - lr * step})
    if kind == "adam":
        h1, s1 = momentum * h + (1 - momentum) * g, momentum2 * h2 + (1 - momentum2) * g * g
        return weights.withColumns({"h": h1, "h2": s1, "w": w - lr * (1 - momentum2**t) ** 0.5 / (1 - momentum**t) * h1 / (F.sqrt(s1) + delta)})
    raise ValueError(f"unknown solver {kind}")
