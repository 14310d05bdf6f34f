"""Words of many texts at once, as array work over their bytes."""

from __future__ import annotations

import numpy as np

from .pieces import numbered, piece_keys

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of non-spaces in texts laid end to end; runs end with their text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different runs, and the number of each run among them; runs of one key are compared byte by byte."""
    example, number = numbered(piece_keys(data, starts, ends))
    sizes = ends - starts
    flat = data.tobytes()
    same = sizes == sizes[example][number]
    if same.all():
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        same = np.array_equal(data[at], data[at + np.repeat(starts[example][number] - starts, sizes)])
    if not np.all(same):
        table: dict[bytes, int] = {}
        number = np.array([table.setdefault(flat[s:e], len(table)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return list(table), number
    return [flat[s:e] for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)], number
