"""Simple-8b: values packed word-aligned, a selector in the top 4 bits of each 64-bit word.

A selector names how many values of how many bits share the other 60 bits. Values that need more than 60 bits
are escapes: a word with the escape selector, and the raw value in the next word. A block carries the word
offset of every `GROUP`-th word and the value offset there, so a reader may decode any part by itself; within
a block all words of one selector are unpacked together.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) of selectors 0 to 13 (fixed values); 15 is the escape.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Words between two entries of a block's directory.
GROUP = 4096

COUNTS = np.array([c for c, _ in PACKS] + [0, 1], dtype=np.int64)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs one."""
    if len(values) and values.max() < 1 << 53:  # exact as doubles, whose exponents tell
        return np.maximum(1, np.frexp(values.astype(np.float64))[1]).astype(np.uint8)
    return np.maximum(1, np.searchsorted(np.array([1 << b for b in range(64)], dtype=np.uint64), values, side="right")).astype(np.uint8)


def selectors(values: np.ndarray) -> np.ndarray:
    """For each position the selector of the word that would start there: the first whose values all fit."""
    n, w = len(values), widths(values)
    best = np.full(n, ESCAPE, dtype=np.uint8)
    best[w <= 60] = 13
    most, length = w, 1
    # windows grow from 1 to 60 values; the last one that still fits has the most values
    for s in range(12, -1, -1):
        count, bits = PACKS[s]
        while length < count:
            step = min(length, count - length)
            if step < n:
                most = np.concatenate([np.maximum(most[:-step], most[step:]), most[-step:]])
            length += step  # past the end a window is what is left
        best[most <= bits] = s
    return best


def encode(values: np.ndarray) -> np.ndarray:
    """uint64 words of the values (uint64 or smaller unsigned)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    sel = selectors(values)
    step = COUNTS[sel].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    sel = sel[at]
    place = np.cumsum(np.where(sel == ESCAPE, 2, 1)) - np.where(sel == ESCAPE, 2, 1)
    words = np.zeros(int(place[-1]) + (2 if sel[-1] == ESCAPE else 1), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s, (count, bits) in enumerate(PACKS):
        here = np.flatnonzero(sel == s)
        if len(here):
            take = padded[at[here][:, None] + np.arange(count)]
            take = take << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[here]] = np.bitwise_or.reduce(take, axis=1) | np.uint64(s << 60)
    here = np.flatnonzero(sel == ESCAPE)
    words[place[here]] = np.uint64(ESCAPE << 60)
    words[place[here] + 1] = values[at[here]]
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):  # rare; a raw word may look like anything
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, COUNTS[sel])
    first = np.cumsum(counts) - counts
    out = np.zeros(int(first[-1] + counts[-1]), dtype=np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        here = np.flatnonzero((sel == s) & ~raw)
        if len(here):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[here][:, None] + np.arange(count)] = (words[here][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    here = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[first[here]] = words[here + 1]
    return out[:n]


def directory(words: np.ndarray) -> np.ndarray:
    """(word offset, value offset) of every GROUP-th word, moved past an escape's raw word."""
    sel = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    first = np.cumsum(np.where(raw, 0, COUNTS[sel])) - np.where(raw, 0, COUNTS[sel])
    at = np.arange(0, len(words), GROUP)
    at = at + raw[at] if len(at) else at
    at = at[at < len(words)]
    return np.stack([at, first[at]], axis=1).astype(np.uint64)


#: Leads every block: name and version of the format.
MAGIC = b"QS8B\x01\x00\x00\x00"


def to_block(values: np.ndarray) -> bytes:
    """magic, number of values, words and directory entries, the directory, the words; all little-endian."""
    words = encode(values)
    index = directory(words)
    head = np.array([len(values), len(words), len(index)], dtype="<u8")
    return MAGIC + head.tobytes() + index.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_block(block: bytes) -> np.ndarray:
    """All values of a block."""
    n, words, _ = _open(block)
    return decode(words, n)


def read_values(block: bytes, start: int, stop: int) -> np.ndarray:
    """Values start to stop of a block; decodes only the groups of words that hold them."""
    n, words, index = _open(block)
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.empty(0, np.uint64)
    g = int(np.searchsorted(index[:, 1], start, side="right")) - 1
    h = int(np.searchsorted(index[:, 1], stop, side="left"))
    end = int(index[h, 0]) if h < len(index) else len(words)
    have = (int(index[h, 1]) if h < len(index) else n) - int(index[g, 1])
    return decode(words[int(index[g, 0]) : end], have)[start - int(index[g, 1]) : stop - int(index[g, 1])]


def _open(block: bytes):
    if block[:8] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, n_words, n_index = np.frombuffer(block, "<u8", 3, 8).tolist()
    index = np.frombuffer(block, "<u8", 2 * n_index, 32).astype(np.int64).reshape(-1, 2)
    return n, np.frombuffer(block, "<u8", n_words, 32 + 16 * n_index), index
