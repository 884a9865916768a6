"""Masks in numpy: run-length codes, set algebra, components and thresholds, as Arrow UDFs where a query needs them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def encode(mask: np.ndarray) -> str:
    """The compressed column-major run lengths of a boolean mask, as COCO writes them."""
    flat = np.asarray(mask, bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(np.r_[False, flat, not flat[-1] if len(flat) else True])) if len(flat) else np.zeros(0, int)
    runs = np.diff(np.r_[0, edges, len(flat)]) if len(flat) else np.zeros(0, int)
    runs = runs[: len(runs) - (len(runs) > 1 and runs[-1] == 0)]
    out = []
    for k, run in enumerate(runs.tolist()):
        x, more = (run - int(runs[k - 2]) if k > 2 else run), True
        while more:
            low = x & 31
            x >>= 5
            more = x != (-1 if low & 16 else 0)
            out.append(chr(48 + (low | 32 * more)))
    return "".join(out)


def decode_runs(counts: str) -> list[int]:
    runs, at = [], 0
    while at < len(counts):
        x, shift, more = 0, 0, True
        while more:
            c = ord(counts[at]) - 48
            x |= (c & 31) << shift
            more, at, shift = bool(c & 32), at + 1, shift + 5
            if not more and c & 16:
                x |= -1 << shift
        runs.append(x + runs[-2] if len(runs) > 2 else x)
    return runs


def decode(counts: str, height: int, width: int) -> np.ndarray:
    runs = decode_runs(counts)
    values = np.arange(len(runs)) % 2 == 1
    return np.repeat(values, runs).reshape((height, width), order="F")


def area(counts: str) -> int:
    return sum(decode_runs(counts)[1::2])


def iou(a: np.ndarray, b: np.ndarray) -> float:
    both = np.logical_or(a, b).sum()
    return float(np.logical_and(a, b).sum() / both) if both else 0.0


def box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the set pixels; None for an empty mask."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else None


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts, in order of their first pixel; 0 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(np.where(mask, label, np.iinfo(np.int64).max), 1, constant_values=np.iinfo(np.int64).max)
        least = np.min([padded[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        after = np.where(mask, least, 0)
        # follow each label to the label of its pixel: distances halve
        flat = np.r_[0, after.ravel()]
        after = np.where(mask, flat[after], 0)
        if (after == label).all():
            break
        label = after
    _, dense = np.unique(np.r_[0, label.ravel()], return_inverse=True)
    return dense[1:].reshape(h, w)


def largest(mask: np.ndarray, k: int = 1) -> np.ndarray:
    """The k largest parts; a mask of k parts or fewer stays as it is."""
    label = components(mask)
    size = np.bincount(label.ravel())[1:]
    return mask if len(size) <= k else np.isin(label, 1 + np.argsort(-size, kind="stable")[:k])


def fill(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: background that no path of neighbours links with the border."""
    h, w = mask.shape
    outside = np.pad(~mask, 1, constant_values=True)
    reach = np.zeros_like(outside)
    reach[0] = True
    while True:
        grown = reach.copy()
        grown[1:] |= reach[:-1]
        grown[:-1] |= reach[1:]
        grown[:, 1:] |= reach[:, :-1]
        grown[:, :-1] |= reach[:, 1:]
        grown &= outside
        if (grown == reach).all():
            return ~reach[1:-1, 1:-1]
        reach = grown


def otsu(gray: np.ndarray) -> int:
    """The grey value that parts the histogram with the largest variance between its sides."""
    n = np.bincount(gray.ravel().astype(np.uint8), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def rle_area(column):
    """Column: the set pixels of each run-length code; null for null."""
    return F.pandas_udf(lambda counts: counts.map(lambda c: None if c is None else area(c)), "long")(column)


def rle_of_box(x, y, w, h, width: int, height: int):
    """Column: the run-length code of a box on a canvas."""
    def code(xs, ys, ws, hs):
        out = []
        for a, b, c, d in zip(xs, ys, ws, hs):
            m = np.zeros((height, width), bool)
            m[b : b + d, a : a + c] = True
            out.append(encode(m))
        return pd.Series(out)

    return F.pandas_udf(lambda a, b, c, d: code(a, b, c, d), "string")(x, y, w, h)


def rle_iou(a, b, width: int, height: int):
    """Column: IoU of two run-length codes of one canvas; null for null."""
    def each(xs, ys):
        return pd.Series([None if p is None or q is None else iou(decode(p, height, width), decode(q, height, width)) for p, q in zip(xs, ys)], dtype="float64")

    return F.pandas_udf(lambda x, y: each(x, y), "double")(a, b)


def rle_covers(code, x: int, y: int, width: int, height: int):
    """Column: whether the mask has the pixel."""
    return F.pandas_udf(lambda c: c.map(lambda v: v is not None and bool(decode(v, height, width)[y, x])), "boolean")(code)


def rle_of_sizes(height, width):
    """Column: the code of a whole image of each size."""
    return F.pandas_udf(lambda h, w: pd.Series([encode(np.ones((int(a), int(b)), bool)) for a, b in zip(h, w)], dtype=object), "string")(height, width)


def rle_box(code, height, width):
    """Column: [x, y, width, height] of the set pixels; null for null, an empty mask and a code of another size."""
    def one(c, h, w):
        if c is None or sum(decode_runs(c)) != int(h) * int(w):
            return None
        return box(decode(c, int(h), int(w)))

    return F.pandas_udf(lambda c, h, w: pd.Series([one(*r) for r in zip(c, h, w)], dtype=object), "array<int>")(code, height, width)
