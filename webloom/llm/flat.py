"""Whole-array handling of text bytes: words and their distinct forms without a Python
object for each occurrence."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
MIX = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE_, LETTER, DIGIT, MARK, ODD = range(5)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions that runs of these starts and lengths cover, run after run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty run of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = spans(starts, lengths)
    inside = at - np.repeat(starts, lengths)
    value = MIX[data[at]] * powers(int(lengths.max()))[inside]
    return np.add.reduceat(value, np.cumsum(lengths) - lengths)


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """First occurrence of each distinct run, and for each run the number of its distinct
    form.  Forms are compared byte by byte; None if two of them share a hash."""
    _, first, which = np.unique(run_hashes(data, starts, lengths) + lengths.astype(np.uint64), return_index=True, return_inverse=True)
    which = which.reshape(-1)
    if (lengths[first][which] != lengths).any():
        return None
    at = spans(starts, lengths)
    same = data[at] == data[at + np.repeat(starts[first][which] - starts, lengths)]
    return (first, which) if same.all() else None


def _classes() -> tuple[np.ndarray, np.ndarray]:
    one = np.full(256, ODD, np.uint8)
    for b in range(0x80):
        c = chr(b)
        one[b] = SPACE_ if b in (0x20, *range(0x09, 0x0E)) else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if 0x21 <= b < 0x7F else ODD
    two = np.full((2, 64), ODD, np.uint8)
    for lead in (0, 1):
        for k in range(64):
            c = chr(0x80 + 64 * lead + k)
            if c.isprintable() and not c.isspace():
                two[lead, k] = LETTER if c.isalpha() else DIGIT if c.isnumeric() else MARK
    two[0, 0x2D] = ODD  # the soft hyphen
    return one, two


ONE, TWO = _classes()


def latin_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split texts of Latin-1 characters as lower-casing word tokenizers do: runs of
    letters, single digits, runs of other marks, and the English contractions 's 't 're
    've 'm 'll 'd on their own.

    Returns the lower-cased bytes, starts and lengths of pieces, and a flag for each text
    that holds any other character (it has no pieces here).
    """
    n = len(data)
    kind = ONE[data]
    low = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    low[upper] += 32
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    trail = np.zeros(n, bool)
    if len(lead):
        ok = lead + 1 < n
        lead = lead[ok]
        k = data[lead + 1]
        c = TWO[(data[lead] == 0xC3).astype(np.int64), k & 63]
        kind[lead] = c
        kind[lead + 1] = c
        trail[lead + 1] = True
        big = (data[lead] == 0xC3) & (k >= 0x80) & (k <= 0x9E) & (k != 0x97)
        low[lead[big] + 1] += 32
    sizes = np.diff(offsets)
    odd_at = np.flatnonzero(kind == ODD)
    odd = np.zeros(len(sizes), bool)
    if len(odd_at):
        odd[np.searchsorted(offsets, odd_at, "right") - 1] = True
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if n > 1 else np.zeros(0, np.int64)
    if len(special):  # "<|" may begin a special token
        odd[np.searchsorted(offsets, special, "right") - 1] = True
    if odd.any():
        kind[spans(offsets[:-1][odd], sizes[odd])] = SPACE_
    begin = np.ones(n, bool)
    if n > 1:
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[offsets[:-1][sizes > 0]] = True
    begin &= ~trail
    # contractions: an apostrophe that is a run of its own, followed by one of the endings
    quote = np.flatnonzero((data == 0x27) & begin & (kind == MARK))
    if len(quote):
        pad = np.concatenate((low, np.zeros(3, np.uint8)))
        is_letter = np.concatenate((kind == LETTER, np.zeros(3, bool)))
        first = np.concatenate((begin, np.ones(3, bool)))
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & is_letter[quote + 1] & first[quote + 1] & (quote + 1 < text_end)
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & is_letter[quote + 1] & first[quote + 1] & is_letter[quote + 2] & (quote + 2 < text_end)
        for at, size in ((quote[one], 1), (quote[two & ~one], 2)):
            begin[at + 1] = False
            nxt = at + 1 + size
            nxt = nxt[nxt < n]
            begin[nxt[kind[nxt] != SPACE_]] = True
    starts = np.flatnonzero(begin)
    lengths = np.diff(np.append(starts, n))
    keep = kind[starts] != SPACE_
    starts, lengths = starts[keep], lengths[keep]
    return low, starts, lengths, odd
