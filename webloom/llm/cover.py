"""Suffix order of a block of text by a difference cover.

A cover D of residues modulo ``V`` holds, for any two positions i and j, some d < V with
i + d and j + d both in the cover.  The cover's positions (a fifth of all) are ranked
first, by prefix doubling in steps of V up to ``DEPTH`` bytes; suffixes are then sorted a
bucket at a time by their first V bytes, and longer ties are resolved by the ranks at
i + d and j + d, so that no comparison reads more than V bytes.
"""

from __future__ import annotations

import numpy as np

V = 31
#: A perfect difference set modulo 31: every residue but 0 is one difference of its members.
COVER = (1, 5, 11, 24, 25, 27)
DEPTH = 8 * V

IN_COVER = np.isin(np.arange(V), COVER)
#: SHIFT[r, s]: the least d with (r + d) and (s + d) in the cover.
SHIFT = np.array([[next(d for d in range(V) if IN_COVER[(r + d) % V] and IN_COVER[(s + d) % V]) for s in range(V)] for r in range(V)], np.int64)
PAD = 2 * DEPTH


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number (its order is theirs)."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def first_names(words: np.ndarray, at: np.ndarray, with_order: bool = False):
    """Ranks of the first V = 31 bytes at each of the positions."""
    keys = [words[at + 24].astype(np.uint64) >> np.uint64(8), *(words[at + k].astype(np.uint64) for k in (16, 8, 0))]
    order = np.lexsort(keys)
    new = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.cumsum(new)
    if with_order:
        return order, rank
    out = np.empty(len(at), np.int64)
    out[order] = rank
    return out


def cover_ranks(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rank of the first DEPTH bytes at each position in the cover; 0 elsewhere and where
    fewer than DEPTH bytes are left."""
    n = len(text) - 40
    at = np.flatnonzero(IN_COVER[np.arange(n) % V])
    ranks = np.zeros(len(text) + DEPTH, np.int64)
    name = first_names(words, at)
    step = V
    while step < DEPTH:
        ranks[at] = name
        name = np.unique(name << 32 | ranks[at + step], return_inverse=True)[1].reshape(-1)
        step *= 2
    ranks[at] = name
    return ranks


def suffix_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the text that follows them (up to DEPTH bytes).

    ``text`` must go on for PAD bytes after the last start.  Ties are cut in three around
    a pivot of each tied group, all groups at once.
    """
    words = words_at(text)
    order, group = first_names(words, starts, with_order=True)
    ranks = cover_ranks(text, words)
    at = starts[order]
    open_ = np.flatnonzero(np.bincount(group, minlength=len(at))[group] > 1)  # places in the result still to be settled
    tied = group[open_]
    while len(open_):
        pos = at[open_]
        begin = np.flatnonzero(np.append(True, tied[1:] != tied[:-1]))
        size = np.diff(np.append(begin, len(tied)))
        pivot = np.repeat(pos[begin + size // 2], size)
        d = SHIFT[pos % V, pivot % V]
        side = np.sign(ranks[pos + d] - ranks[pivot + d])
        number = np.repeat(np.arange(len(begin)), size)
        key = number * 3 + (side + 1)
        again = np.argsort(key, kind="stable")
        at[open_] = pos[again]
        key = key[again]
        # what equals the pivot is settled, and so is a part of one
        count = np.bincount(key, minlength=3 * len(begin))
        keep = (key % 3 != 1) & (count[key] > 1)
        open_, tied = open_[keep], key[keep]
    return at


def same_next(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes (8 at least) agree at each pair of positions."""
    words = words_at(text)
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        left = left[words[a[left] + k] == words[b[left] + k]]
        if not len(left):
            return out
    out[left] = True
    return out
