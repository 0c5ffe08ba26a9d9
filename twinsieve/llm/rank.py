"""Sorting suffixes of integer arrays."""

from __future__ import annotations

import numpy as np


def dense_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, the dense rank of each (from 1), and the number of ranks."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    fresh = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(fresh)
    return order, ranks, int(fresh.sum())


def suffix_order(values: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` values at least, by prefix doubling.

    A zero ends a suffix: what follows it is not compared.
    """
    if not len(values):
        return np.empty(0, np.int64)
    order, ranks, count = dense_ranks(values)
    if values.min() <= 0:  # zero keeps the rank 0
        ranks = ranks - 1
    step = 1
    while step < depth and count < len(values):
        after = np.zeros(len(values), np.int64)
        after[:-step or None] = ranks[step:] if step < len(ranks) else 0
        after[ranks == 0] = 0
        order, ranks, fresh = dense_ranks(ranks * (len(values) + 2) + after)
        if values.min() <= 0:
            ranks = ranks - 1
        if fresh == count:
            break
        count = fresh
        step *= 2
    return order
