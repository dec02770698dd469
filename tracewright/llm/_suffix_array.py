"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as S (smaller than the next one) or L (larger).  The substrings
between leftmost S suffixes (LMS) are sorted by one round of induction and named; the
string of names is sorted recursively; from the sorted LMS suffixes a second round induces
all suffixes.  Byte strings are induced bucket by bucket with vector operations (what one
bucket adds to itself comes in waves); strings of names have too many buckets for that and
are induced one suffix at a time.
"""

from __future__ import annotations

import numpy as np

from tracewright.llm._words import U, mix, powers


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one, the sentinel, is."""
    n = len(t)
    s = np.empty(n, bool)
    s[-1] = True
    if n > 1:
        differs = t[:-1] != t[1:]
        place = np.where(differs, np.arange(n - 1), n - 1)
        place = np.minimum.accumulate(place[::-1])[::-1]  # where the run of equal characters ends
        smaller = np.append(t[:-1] < t[1:], True)
        s[:-1] = smaller[place]
    return s


def _induce_bytes(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array induced from LMS suffixes that are in order, by their first characters at least."""
    n = len(t)
    out = np.full(n, -1, np.int64)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    by_char = t[lms]
    lms_cuts = np.searchsorted(by_char, np.arange(size + 1))
    present = np.flatnonzero(counts)

    heads = starts.copy()

    def push_larger(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[~s[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        added = np.bincount(c, minlength=size)
        out[heads[c] + np.arange(len(c)) - (np.cumsum(added) - added)[c]] = p
        heads[:] += added

    for c in present:
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            push_larger(out[done:upto])
            done = upto
        if lms_cuts[c + 1] > lms_cuts[c]:
            push_larger(lms[lms_cuts[c] : lms_cuts[c + 1]])

    tails = ends.copy()

    def push_smaller(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[s[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        added = np.bincount(c, minlength=size)
        out[tails[c] - 1 - np.arange(len(c)) + (np.cumsum(added) - added)[c]] = p
        tails[:] -= added

    for c in present[::-1]:
        if c == t[-1]:  # the sentinel is the one suffix that nothing induces
            tails[c] -= 1
            out[tails[c]] = n - 1
        done = ends[c]
        while done > tails[c]:
            down = tails[c]
            push_smaller(out[down:done][::-1])
            done = down
        if heads[c] > starts[c]:
            push_smaller(out[starts[c] : heads[c]][::-1])
    return out


def _induce_names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t, minlength=size)
    last = np.cumsum(counts)
    heads, tails = (last - counts).tolist(), last.tolist()
    chars, small = t.tolist(), s.tolist()
    out = [-1] * n
    for j in reversed(lms.tolist()):
        c = chars[j]
        tails[c] -= 1
        out[tails[c]] = j
    for j in out:  # the list grows ahead of this loop
        if j > 0 and not small[j - 1]:
            c = chars[j - 1]
            out[heads[c]] = j - 1
            heads[c] += 1
    tails = last.tolist()
    for i in range(n - 1, -1, -1):
        j = out[i]
        if j > 0 and small[j - 1]:
            c = chars[j - 1]
            tails[c] -= 1
            out[tails[c]] = j - 1
    out[0] = n - 1
    return np.array(out, np.int64)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """t: integers under ``size``; the last one is the only 0."""
    n = len(t)
    if n <= 2:
        return np.argsort(t, kind="stable")
    induce = _induce_bytes if size <= 300 else _induce_names
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) <= 1:
        return induce(t, s, lms, size)
    by_first = lms[np.argsort(t[lms], kind="stable")]
    rough = induce(t, s, by_first, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]  # LMS suffixes in the order of their LMS substrings

    # names: equal for equal substrings, which are compared by hashes of characters and length
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(t.astype(U) + U(1)) * up[:n], out=sums[1:])
    ends = np.append(lms[1:], n - 1)
    hashed = np.zeros(n, U)
    hashed[lms] = mix((sums[ends + 1] - sums[lms]) * down[lms]) + (ends - lms).astype(U)
    keys = hashed[ordered]
    name = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    names = np.zeros(n, np.int64)
    names[ordered] = name
    reduced = names[lms]
    if name[-1] + 1 == len(lms):
        exact = ordered
    else:
        exact = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(t, s, exact, size)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text place: the common prefix (counted up to ``most``) with the suffix before it in order.

    Where the characters before both suffixes are equal, the value is one less than that
    of the previous place; only the other places are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    start = np.flatnonzero(~((before > 0) & (here > 0) & (t[np.maximum(here - 1, 0)] == t[np.maximum(before - 1, 0)])))
    length = np.zeros(len(start), np.int64)
    active = np.flatnonzero(before[start] >= 0)
    i, j = start[active], before[start[active]]
    step = 0
    while len(active):
        inside = np.flatnonzero((i + step < n) & (j + step < n))
        inside = inside[t[i[inside] + step] == t[j[inside] + step]]
        active, i, j = active[inside], i[inside], j[inside]
        step += 1
        length[active] = step
    origin = np.zeros(n, np.int64)
    origin[start] = np.arange(len(start))
    origin = np.maximum.accumulate(origin)
    return np.minimum(np.maximum(0, length[origin] - (here - start[origin])), most)
