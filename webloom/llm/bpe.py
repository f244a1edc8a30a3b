"""Byte-pair merges replayed over a whole collection of words at once.

The words of a chunk of the corpus are laid out as one flat array of symbols.  An
inverted index goes from each pair's rank to the positions where that pair stands;
merges are taken from it in rank order, and a merge touches only its positions and
their two neighbours, which enter the index under their new ranks.  Words never
interact, so replaying chunk by chunk gives what a replay of the whole corpus gives.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
DENSE = 512


class MergeTable:
    """Pairs of symbol ids with the rank and the id of what they merge into.

    ``safe[i]`` says that merging pair ``i`` everywhere cannot create a pair of lower
    rank, so that all its occurrences in a word may be merged together.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        order = np.lexsort((right, left))
        left, right, rank, made = (np.asarray(x, np.int64)[order] for x in (left, right, rank, made))
        self.keys = (left << 32) | right
        self.ranks = np.append(rank, NONE).astype(np.int32)
        top = int(max(made.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1
        lowest = np.full(top, NONE, np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.pair_of = {}
        for a, b, r, m, ok in zip(left.tolist(), right.tolist(), rank.tolist(), made.tolist(), (lowest[made] > rank).tolist(), strict=True):
            self.pair_of.setdefault(r, []).append((a, b, m, ok))
        # several splits of one token share its rank: they merge into the same id
        self.made_of = {r: v[0][2] for r, v in self.pair_of.items()}
        self.safe_of = {r: all(x[3] for x in v) for r, v in self.pair_of.items()}
        del self.pair_of
        self.dense = np.full((DENSE, DENSE), NONE, np.int32)
        low = (left < DENSE) & (right < DENSE)
        self.dense[left[low], right[low]] = rank[low]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        if not len(self.keys):
            return np.full(len(key), NONE, np.int32)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def rank_table(ranks: dict[bytes, int]) -> MergeTable:
    """The table of a vocabulary in which a token's rank is its id: every split of a
    token into two tokens is a merge of that rank."""
    left, right, made = [], [], []
    get = ranks.get
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a = get(token[:i])
            if a is not None and (b := get(token[i:])) is not None:
                left.append(a)
                right.append(b)
                made.append(r)
    made_ = np.array(made, np.int64)
    return MergeTable(np.array(left, np.int64), np.array(right, np.int64), made_, made_)


def replay(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge words given as flat symbols and the length of each.

    Returns the flat ids and the number of ids of each word.  An empty input gives
    empty outputs.
    """
    n = len(symbols)
    lengths = np.asarray(lengths, np.int64)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    sym = np.append(np.asarray(symbols, np.int32), np.int32(-1))
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    nxt = np.arange(1, n + 2, dtype=np.int32)
    prv = np.arange(-1, n, dtype=np.int32)
    last = np.ones(n, bool)
    last[:-1] = word[1:] != word[:-1]
    nxt[:n][last] = n
    first = np.ones(n, bool)
    first[1:] = last[:-1]
    prv[:n][first] = n
    alive = np.ones(n, bool)
    rank = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(~last)
    a, b = sym[inner], sym[inner + 1]
    low = (a < DENSE) & (b < DENSE)
    got = np.full(len(inner), NONE, np.int32)
    got[low] = table.dense[a[low], b[low]]
    if not low.all():
        got[~low] = table.lookup(a[~low], b[~low])
    rank[inner] = got
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cut.tolist(), len(at)]
        for r, lo, hi in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            if (has := index.get(r)) is None:
                index[r] = [at[lo:hi]]
                heapq.heappush(heap, r)
            else:
                has.append(at[lo:hi])

    known = got != NONE
    if known.any():
        enter(inner[known].astype(np.int32), got[known])
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == r]
        if len(parts) > 1 and len(at) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        if len(at) > 1:
            if table.safe_of[r]:
                joined = nxt[at[:-1]] == at[1:]
                if joined.any():  # overlapping occurrences: every other one of a run, from the left
                    starts = np.append(True, ~joined)
                    where = np.arange(len(at))
                    begun = np.maximum.accumulate(np.where(starts, where, 0))
                    at = at[(where - begun) % 2 == 0]
            else:
                w = word[at]
                lead = np.append(True, w[1:] != w[:-1])
                if not lead.all():
                    index[r] = [at[~lead]]
                    heapq.heappush(heap, r)
                    at = at[lead]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = table.made_of[r]
        alive[gone] = False
        rank[gone] = NONE
        nxt[at] = after
        prv[after] = at
        before = prv[at]
        some, other = before[before != n], at[after != n]
        rank[at] = NONE
        touched = np.concatenate((some, other))
        if len(touched):
            new = table.lookup(sym[touched], sym[nxt[touched]])
            rank[touched] = new
            known = new != NONE
            if known.any():
                enter(touched[known], new[known])
    left = np.flatnonzero(alive)
    return sym[left], np.bincount(word[left], minlength=len(lengths)).astype(np.int64)
