"""Suffix arrays by induced sorting, and common prefixes in text order, in NumPy.

Suffixes are classed as smaller or larger than their right neighbour; leftmost-smaller ones are
sorted by their substrings, named, and ranked; all others follow by two passes of induction.
Induction goes bucket by bucket: what a bucket has gathered is complete before it is read, save
for its own letter's runs, which take one more wave for each repetition.

The ranks of the reduced string come from doubling, again and again until no two are equal or
``depth`` letters have been compared: beyond that, order does not matter to a caller who asks for
common prefixes of up to ``depth`` letters.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of ``text`` (small non-negative integers; the last is 0 and unique).

    Suffixes that agree in more than ``depth`` letters may stand in any order among themselves.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    # S type: smaller than the suffix to the right; in a run of one letter all are as the last is.
    smaller = np.zeros(n, bool)
    smaller[n - 1] = True
    change = np.flatnonzero(text[:-1] != text[1:])
    kinds = text[change] < text[change + 1]
    smaller[: n - 1] = np.repeat(kinds, np.diff(np.r_[-1, change]))[: n - 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    letters = int(text.max()) + 1
    bounds = np.zeros(letters + 1, np.int64)
    np.cumsum(np.bincount(text, minlength=letters), out=bounds[1:])
    sa = induced(text, smaller, lms, bounds)
    order = sa[mark(n, lms)[sa]]
    names = named(text, lms, order)
    if names.max() + 1 < len(lms):
        names = doubled(names, text, lms, depth)
    return induced(text, smaller, lms[np.argsort(names, kind="stable")], bounds)


def mark(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def place(sa: np.ndarray, ends: np.ndarray, at: np.ndarray, letter: np.ndarray, step: int) -> None:
    """Put suffixes, in order, at the next free places of their letters' buckets (step 1: from the left)."""
    order = np.argsort(letter, kind="stable")
    sorted_letters = letter[order]
    first = np.flatnonzero(np.r_[True, sorted_letters[1:] != sorted_letters[:-1]])
    sizes = np.diff(np.r_[first, len(order)])
    keys = sorted_letters[first]
    within = np.arange(len(order)) - np.repeat(first, sizes)
    sa[np.repeat(ends[keys], sizes) + step * within] = at[order]
    ends[keys] += step * sizes


def induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order."""
    n, letters = len(text), len(bounds) - 1
    sa = np.full(n, -1, np.int64)
    # The letter before each place, where that is a larger one (or a smaller one), so that one look tells both.
    none = np.min_scalar_type(letters).type(letters)
    larger_letter, smaller_letter = np.full(n, none), np.full(n, none)
    np.copyto(larger_letter[1:], text[:-1], where=~smaller[:-1], casting="unsafe")
    np.copyto(smaller_letter[1:], text[:-1], where=smaller[:-1], casting="unsafe")

    def place_before(at: np.ndarray, before: np.ndarray, ends: np.ndarray, step: int) -> None:
        letter = before.take(at)
        has = letter != none
        if has.any():
            place(sa, ends, at[has] - 1, letter[has], step)

    # Seeds wait at their letter's place in order; only their predecessors are needed in pass one.
    seed_letters = text[seeds]
    by_letter = np.argsort(seed_letters, kind="stable")
    seed_bounds = np.searchsorted(seed_letters[by_letter], np.arange(letters + 1))
    heads = bounds[:-1].copy()
    for c in range(letters):
        lo = bounds[c]
        while lo < heads[c]:
            hi = heads[c]
            place_before(sa[lo:hi], larger_letter, heads, 1)
            lo = hi
        place_before(seeds[by_letter[seed_bounds[c] : seed_bounds[c + 1]]], larger_letter, heads, 1)
    tails = bounds[1:] - 1
    larger_end = heads
    # The last letter's suffix is smallest of all and has no larger one in its bucket.
    sa[0] = n - 1
    tails[0] = -1
    for c in range(letters - 1, -1, -1):
        hi = bounds[c + 1] - 1
        while hi > tails[c] and c > 0:
            lo = tails[c]
            place_before(sa[lo + 1 : hi + 1][::-1], smaller_letter, tails, -1)
            hi = lo
        place_before(sa[bounds[c] : larger_end[c]][::-1] if c > 0 else sa[:1], smaller_letter, tails, -1)
    return sa


def packed(text: np.ndarray, pad: int) -> np.ndarray:
    """The letters from each place on, as many as a word of 64 bits holds, the first lowest; zeros past the end."""
    words, k = np.r_[text, np.zeros(pad + 8, text.dtype)], 1
    while words.itemsize < 8:
        wide = np.dtype(f"u{2 * words.itemsize}").type
        words, bits = words.astype(wide), wide(8 * words.itemsize)
        words, k = words[:-k] | words[k:] << bits, 2 * k
    return words


def named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A name for each leftmost-smaller substring, in text order; equal ones share it."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    size = length[order]
    same = size[1:] == size[:-1]
    at, k, per = np.flatnonzero(same), 0, 8 // text.itemsize
    words = packed(text, per)
    while len(at):
        diff = words.take(order[at] + k) ^ words.take(order[at + 1] + k)
        # Letters past the substring's end don't count.
        diff <<= (np.maximum(0, per - size[at] + k) * 8 * text.itemsize).astype(np.uint64)
        equal = diff == 0
        same[at[~equal]] = False
        k += per
        at = at[equal]
        at = at[size[at] > k]
    rank = np.r_[0, np.cumsum(~same)]
    names = np.zeros(n, np.int64)
    names[order] = rank
    return names[lms]


def doubled(names: np.ndarray, text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the reduced string's suffixes, equal only beyond ``depth`` letters.

    A rank is the number of smaller suffixes, so one that no other shares is final: only shared ones
    are sorted again, by as many ranks in a row as a word holds.
    """
    n, reach = len(names), 1
    bits = n.bit_length()
    at = np.arange(n)
    # Ranks from one on; past the end they are zero, less than any.
    ranks = np.zeros(n + 1, np.int64)
    ranks[:n] = (np.cumsum(np.bincount(names)) - np.bincount(names))[names] + 1
    while True:
        key, base = ranks[at], ranks[at]
        for k in range(1, 63 // bits):
            key = key << bits | ranks.take(at + k * reach, mode="clip")
        order = np.argsort(key)
        at, key, base = at[order], key[order], base[order]
        fresh, first = np.ones(len(at), bool), np.ones(len(at), bool)
        fresh[1:], first[1:] = key[1:] != key[:-1], base[1:] != base[:-1]
        here = np.arange(len(at))
        ranks[at] = base + np.maximum.accumulate(here * fresh) - np.maximum.accumulate(here * first)
        at = at[~fresh | np.r_[~fresh[1:], False]]
        reach *= 63 // bits
        # Two letters at least lie between one leftmost-smaller place and the next.
        if not len(at) or reach >= n or 2 * (reach - 1) >= depth:
            return ranks[:n] - 1


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, forced: np.ndarray, least: int = 0) -> np.ndarray:
    """The common prefix of each suffix with its predecessor in the array, in text order, up to ``cap``.

    Places whose left neighbours agree follow from the place before them (one less); the others,
    and ``forced`` ones, are compared some letters at a time.  Prefixes shorter than ``least`` may
    be given as any length below it: most of them end with one look at where they would reach.
    """
    n, per = len(text), 8 // text.itemsize
    prior = np.empty(n, np.int64)
    prior[sa[1:]] = sa[:-1]
    prior[sa[0]] = -1
    words = packed(text, cap)
    direct = np.ones(n, bool)
    direct[1:] = (prior[1:] < 1) | (text[:-1] != text.take(prior[1:] - 1, mode="clip"))
    direct[forced] = True
    todo = np.flatnonzero(direct & (prior >= 0))
    plcp = np.zeros(n, np.int64)
    if per <= least <= cap:
        todo = todo[words.take(todo + least - per) == words.take(prior.take(todo) + least - per)]
    other, k = prior[todo], 0
    while len(todo) and k < cap:
        diff = words.take(todo + k) ^ words.take(other + k)
        equal = diff == 0
        low = diff[~equal]
        low &= np.uint64(0) - low
        plcp[todo[~equal]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // (8 * text.itemsize)
        todo, other, k = todo[equal], other[equal], k + per
        inside = (todo + k < n) & (other + k < n)
        plcp[todo[~inside]] = np.minimum(n - todo[~inside], n - other[~inside])
        todo, other = todo[inside], other[inside]
    plcp[todo] = cap
    source = np.maximum.accumulate(np.where(direct, np.arange(n), 0))
    return np.maximum(plcp[source] - (np.arange(n) - source), 0)
