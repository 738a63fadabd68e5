"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


def fit(raw: np.ndarray, label: np.ndarray, strength: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the non-decreasing fit: each pooled block's mean score and its share of ones.

    The share is drawn to that of all labels as if by strength further rows, so a block of few rows is not taken for sure.
    """
    if not len(raw):
        return np.zeros(1), np.full(1, 0.5)
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for x, y in zip(raw[order].tolist(), label[order].tolist()):
        blocks.append([1.0, y, x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + t]
    prior = float(label.mean())
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], (b[:, 1] + strength * prior) / (b[:, 0] + strength)


def apply(knots: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """Probabilities: linear between the knots, so that different scores seldom tie; flat beyond them."""
    return np.clip(np.interp(raw, knots[0], np.maximum.accumulate(knots[1])), 0.0, 1.0)
