"""All pairs of two blocks of sets by matrix products."""

from __future__ import annotations

import numpy as np


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i in left, j in right) at or over the threshold as an array of two columns."""
    sizes = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 36:
        found = []
        for i in left:
            for j in right:
                lo, hi = sorted((sizes[i], sizes[j]))
                if i != j and lo >= threshold * hi:
                    n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if n >= threshold * (lo + hi - n) - 1e-9:
                        found.append((i, j))
        return np.array(found, np.int64).reshape(-1, 2)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    renamed = np.cumsum(count > 1) - 1
    owner, code = owner[shared], renamed[code[shared]]
    n_codes = int((count > 1).sum())
    inter = np.zeros((len(left), len(right)), np.float32)
    at_left = np.full(len(sets), -1)
    at_left[left] = np.arange(len(left))
    at_right = np.full(len(sets), -1)
    at_right[right] = np.arange(len(right))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = 4096
    for lo in range(0, n_codes, step):
        a, b = np.searchsorted(code, [lo, lo + step])
        o, c = owner[a:b], code[a:b] - lo
        x = np.zeros((len(left), step), np.float32)
        y = np.zeros((len(right), step), np.float32)
        k = at_left[o]
        x[k[k >= 0], c[k >= 0]] = 1
        k = at_right[o]
        y[k[k >= 0], c[k >= 0]] = 1
        inter += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    i, j = np.nonzero((inter >= threshold * union - 1e-6) & (left[:, None] != right[None, :]))
    return np.stack([left[i], right[j]], 1)
