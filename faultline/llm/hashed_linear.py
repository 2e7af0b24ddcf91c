"""Hashed byte n-gram features and small linear models fitted with numpy on the driver."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 19
#: Odd multipliers that spread byte pairs and triples over the hash range.
_SPREAD = np.array([2654435761, 40503, 2246822519], dtype=np.uint64)


def ngram_counts(data: bytes, dims: int, table: np.ndarray | None = None) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the whole text; ``dims`` is a power of two.

    ``table`` maps each byte first; byte 0 after that marks a place no n-gram may cover.
    Long texts go block by block, so memory stays bounded.
    """
    out = np.zeros(dims, dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        raw = np.frombuffer(data, dtype=np.uint8, count=min(BLOCK + 2, len(data) - at), offset=at)
        x = (raw if table is None else table[raw]).astype(np.uint64)
        if len(x) < 2:
            continue
        two = x[:-1] * _SPREAD[0] + x[1:] * _SPREAD[1]
        fine = (x[:-1] != 0) & (x[1:] != 0)
        take = min(BLOCK, len(two))
        out += np.bincount((((two[:take] >> np.uint64(7)) & np.uint64(dims - 1)).astype(np.int64))[fine[:take]], minlength=dims)
        if len(x) < 3:
            continue
        three = two[:-1] + x[2:] * _SPREAD[2] * np.uint64(31)
        fine = fine[:-1] & (x[2:] != 0)
        take = min(BLOCK, len(three))
        out += np.bincount((((three[:take] >> np.uint64(9)) & np.uint64(dims - 1)).astype(np.int64))[fine[:take]], minlength=dims)
    return out


def normal(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, scaled to unit length."""
    x = np.sqrt(counts).astype(np.float32)
    size = float(np.sqrt((x * x).sum()))
    return x / size if size else x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Independent logistic models for the columns of ``y`` (targets from 0 to 1): (dims x k, k)."""
    n, k = y.shape
    w, b = np.zeros((x.shape[1], k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    share = (np.full(n, 1 / max(n, 1)) if weight is None else weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(steps):
        error = (sigmoid(x @ w + b) - y).astype(np.float32) * share
        speed_w = 0.9 * speed_w - rate * (x.T @ error + decay * w)
        speed_b = 0.9 * speed_b - rate * error.sum(0)
        w, b = w + speed_w, b + speed_b
    return w, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
