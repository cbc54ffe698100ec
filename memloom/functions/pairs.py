"""Pairs of neighbouring characters, counted in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Characters that are counted at once, unless one text has more, and marks of one table.
AT_ONCE, MARKS = 2_000_000, 1 << 24


def _distinct(texts: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    if not len(code):
        return np.zeros(len(texts), np.int64)
    seen = np.zeros(int(code.max()) + 1, bool)
    seen[code] = True
    n = int(seen.sum())
    place = (np.cumsum(seen) - 1)[code]
    pair = place[:-1] * n + place[1:]
    ends = np.cumsum(length)
    out = np.zeros(len(texts), np.int64)
    few = n * n <= MARKS
    marks = np.zeros(n * n if few else 0, bool)
    for i, end in enumerate(ends):
        own = pair[end - length[i] : end - 1] if length[i] > 1 else pair[:0]
        if not few or len(own) * 20 < len(marks):
            out[i] = len(np.unique(own))
        else:
            marks[own] = True
            out[i] = np.count_nonzero(marks)
            marks[:] = False
    return out


def n_bigrams(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many distinct pairs of neighbouring characters each text has."""
    for batch in texts:
        counts, some, size = [], [], 0
        for text in batch:
            some.append(text.as_py() or "")
            size += len(some[-1])
            if size >= AT_ONCE:
                counts.append(_distinct(some))
                some, size = [], 0
        counts.append(_distinct(some))
        yield pa.array(np.concatenate(counts), pa.int64())
