"""Suffix order by the difference-cover algorithm, in numpy."""

from __future__ import annotations

import numpy as np


def names_of(key: np.ndarray) -> np.ndarray:
    """Order-preserving dense names, from 1."""
    top = int(key.max(initial=0))
    if top < 1 << 24:
        there = np.zeros(top + 2, np.int64)
        there[key + 1] = 1
        return np.cumsum(there)[key + 1]
    return np.unique(key, return_inverse=True)[1] + 1


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integers ordered as the pairs (a, b)."""
    most = int(b.max(initial=0)) + 1
    if int(a.max(initial=0)) < (1 << 62) // most:
        return a * most + b
    return (np.unique(a, return_inverse=True)[1]) * most + b


def ranks(s: np.ndarray, depth: int = 64) -> np.ndarray:
    """The place (from 1) of each suffix of s, whose values are positive, in the order of suffixes.

    Triples at the places 1 and 2 modulo 3 are sorted and named; if names repeat, the suffixes of the text of names are
    ordered by recursion; the other suffixes are then ordered by their first value and the rank behind it, and merged in.
    With a depth the recursion ends after so many levels: suffixes whose first 3^depth values differ are still in order.
    """
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    t = np.concatenate([s, [0, 0, 0, 0]])
    p1, p2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with the empty suffix, if it follows the last of the third kind
    p = np.concatenate([p1, p2])
    names = names_of(joined(joined(t[p], t[p + 1]), t[p + 2]))
    if depth > 1 and int(names.max()) < len(names):
        order = np.argsort(ranks(names, depth - 1), kind="stable")
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 5, np.int64)
    rank[p[order]] = np.arange(1, len(p) + 1)
    p0 = np.arange(0, n, 3)
    own = joined(t[p0], rank[p0 + 1])
    first = np.argsort(own, kind="stable")
    p0 = p0[first]
    one = np.concatenate([p1, p0])
    key = joined(t[one], rank[one + 1])
    less = np.searchsorted(np.sort(key[: len(p1)]), key[len(p1) :])
    two = np.concatenate([p2, p0])
    key = joined(joined(t[two], t[two + 1]), rank[two + 2])
    less += np.searchsorted(np.sort(key[: len(p2)]), key[len(p2) :])
    place = np.concatenate([2 * rank[p] - 1, 2 * less])  # a suffix with so many of the sampled before it
    who = np.concatenate([p, p0])
    order = who[np.argsort(place, kind="stable")]
    order = order[order < n]
    out = np.empty(n, np.int64)
    out[order] = np.arange(1, n + 1)
    return out


def repeated(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Starts, in order, of the strings of so many bytes that occur more than once in the rows of text that end at ends.

    Rows are kept apart by a value below all bytes. Neighbours in suffix order are compared by their whole first length bytes.
    """
    size = np.diff(np.concatenate([[0], ends]))
    s = np.ones(len(text) + len(ends), np.int64)
    row = np.repeat(np.arange(len(ends)), size)
    at = np.arange(len(text)) + row
    used = np.zeros(256, np.int64)
    used[text] = 1
    s[at] = np.cumsum(used)[text] + 1
    depth = 1
    while 3**depth < length:
        depth += 1
    rank = ranks(s, depth)
    fits = np.flatnonzero(ends[row] - np.arange(len(text)) >= length)
    order = fits[np.argsort(rank[at[fits]])]
    windows = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    same = np.zeros(len(order) + 1, bool)
    for i in range(0, len(order) - 1, 20_000):
        a, b = order[i : min(len(order) - 1, i + 20_000)], order[i + 1 : i + 20_001]
        alike = np.flatnonzero((text[a] == text[b]) & (text[a + length - 1] == text[b + length - 1]) & (text[a + length // 2] == text[b + length // 2]))
        alike = alike[(windows[a[alike]] == windows[b[alike]]).all(axis=1)]
        same[i + 1 + alike] = True
    return np.sort(order[same[:-1] | same[1:]])
