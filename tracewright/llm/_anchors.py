"""Anchors of fixed-length windows: where equal windows of a corpus can meet.

A window's anchor is its least-hashed ``GRAM``-byte gram (the leftmost of equals), so equal
windows have equal anchors at equal offsets.  Neighbouring windows mostly share one; an
anchor occurrence stands for the run of window starts that chose it.
"""

from __future__ import annotations

import numpy as np

from tracewright.llm._words import _CODES as _WORD_CODES
from tracewright.llm._words import U, mix, powers

GRAM = 32
_PLACE = 28
_CODES = mix(_WORD_CODES + U(17) * np.arange(256, dtype=U))  # tells A-Z and a-z apart


def window_anchors(raw: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All anchor occurrences of windows of ``length`` bytes inside the rows of ``raw``.

    row; pos: the gram's start in the row; first, last: its windows' first and last start
    in the row; gram: the gram's hash; context: hash of all bytes of its windows and of
    the place of the gram in them.
    """
    n, width = len(raw), length - GRAM + 1
    starts = n - length + 1
    if starts <= 0:
        return {k: np.zeros(0, np.int64) for k in ("row", "pos", "first", "last")} | {k: np.zeros(0, U) for k in ("gram", "context")}
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_CODES[raw] * up[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]
    least = (mix(grams) >> U(_PLACE) << U(_PLACE)) | np.arange(len(grams), dtype=U)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least & U((1 << _PLACE) - 1)).astype(np.int64)  # by window start
    row_end = np.repeat(at[1:], np.diff(at))[:starts]
    fits = np.arange(starts) + length <= row_end
    valid = np.flatnonzero(fits)
    if not len(valid):
        return window_anchors(raw[:0], at[:1], length)
    pick = chosen[valid]
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (valid[1:] != valid[:-1] + 1)])
    begin = np.flatnonzero(new)
    first, last = valid[begin], valid[np.append(begin[1:], len(valid)) - 1]
    pos = pick[begin]
    row = np.searchsorted(at, first, side="right") - 1
    inside = (sums[last + length] - sums[first]) * down[first]
    place = ((pos - first) << 8 | (last - first)).astype(U)
    return {"row": row, "pos": pos - at[row], "first": first - at[row], "last": last - at[row], "gram": mix(grams[pos]), "context": mix(mix(inside) + place)}
