"""Places in a text that are chosen by what stands there: of each window, the grams with the smallest hash."""

from __future__ import annotations

import numpy as np

from .common import _INVERSE, _MULT, U64, mix, powers

NEVER = U64(0xFFFFFFFFFFFFFFFF)


def slide(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[k : k + width] for each k, as if x went on with fill."""
    n = len(x)
    blocks = -(-(n + width) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """A hash of flat[k : k + width] for each k that has so many bytes."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(flat) + 1, U64)
    np.cumsum((flat.astype(U64) + U64(1)) * powers(_MULT, len(flat)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE, n))


def anchors(flat: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that end at ends in flat: the grams such that each run of length bytes within one text has one at least,
    chosen by the run's bytes alone. Returns their places in flat and their hashes."""
    n, span = len(flat), length - gram + 1
    hashes = gram_hashes(flat, gram)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    owner_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(hashes)]
    at = np.arange(len(hashes))
    hashes = np.minimum(hashes, NEVER - U64(1))
    inside = np.where(at + gram <= owner_end, hashes, NEVER)
    least = slide(inside, span, np.minimum, NEVER)
    least[at + length > owner_end] = 0
    most = np.zeros(len(least) + span - 1, U64)
    most[span - 1 :] = least
    chosen = np.flatnonzero(slide(most, span, np.maximum, 0)[: len(hashes)] == inside)
    return chosen, hashes[chosen]
