"""Folds over the ordered rows of groups, many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def waves(groups: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of sorted groups (equal values next to each other) in waves: the first row of every group, the second, and so on."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    turn = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
    order = np.argsort(turn, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(turn[order])) + 1))
