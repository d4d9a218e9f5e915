"""Simple-8b: as many ids as fit share one 64-bit word; the top 4 bits say how.

Selector s of 1 to 14 packs COUNTS[s] values of WIDTHS[s] bits, first value lowest.
Selector 0 is an escape: the next word is one id of over 60 bits, as it is.  Ids are coded
in blocks of ``BLOCK``; a block starts a new word, its last word is filled with zeros, and
the word offset of each block is kept.  So any block can be decoded alone, and all blocks
of a chunk are decoded together by array operations, one for each selector.
"""

from __future__ import annotations

import numpy as np

#: fixed values of the code: values a word and bits a value, by selector
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024

_U = np.uint64


def _bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for zero; up to 2^53 a double's exponent has them exactly."""
    if len(ids) and int(ids.max()) >= 1 << 53:
        return np.searchsorted(_U(1) << np.arange(64, dtype=np.uint64), ids, side="right").astype(np.uint8)
    exponent = (ids.astype(np.float64).view(np.int64) >> 52) - 1022
    return np.maximum(exponent, 0).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word offset of each block, and the indexes of raw words."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    reach = BLOCK + 64
    values = np.zeros((rows, reach), np.uint64)
    body = np.zeros(rows * BLOCK, np.uint64)
    body[:n] = ids
    values[:, :BLOCK] = body.reshape(rows, BLOCK)
    widths = _bit_widths(values.ravel()).reshape(values.shape)
    widest = {1: widths}
    for p in (2, 4, 8, 16, 32):
        half = widest[p // 2]
        widest[p] = half.copy()
        np.maximum(half[:, : reach - p // 2], half[:, p // 2 :], out=widest[p][:, : reach - p // 2])
    best = np.full((rows, BLOCK), 15, np.uint8)
    for s in range(1, 15):  # if many narrow values fit, so do fewer wide ones
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(widest[p][:, :BLOCK], widest[p][:, c - p : c - p + BLOCK])
        best -= most <= WIDTHS[s]
    best[best == 15] = 0
    ends = np.full(rows, BLOCK)
    ends[-1] = n - (rows - 1) * BLOCK
    at, step, places, choices, live = np.zeros(rows, np.int64), np.maximum(COUNTS, 1), [], [], np.arange(rows)
    while len(live):  # every block takes one word in each turn
        chosen = best[live, at[live]]
        places.append(live * reach + at[live])
        choices.append(chosen)
        at[live] += step[chosen]
        live = live[at[live] < ends[live]]
    place, choice = np.concatenate(places), np.concatenate(choices)
    order = np.argsort(place, kind="stable")
    place, choice = place[order], choice[order]
    flat = values.ravel()
    words = choice.astype(np.uint64) << _U(60)
    for s in range(1, 15):
        who = np.flatnonzero(choice == s)
        if len(who):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[who] |= np.bitwise_or.reduce(flat[place[who][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    size = np.where(choice == 0, 2, 1)
    to = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[to] = words
    raw = to[choice == 0] + 1
    out[raw] = flat[place[choice == 0]]
    first = np.searchsorted(place, np.arange(rows) * reach)
    return out, to[first].astype(np.uint32), raw.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of all blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> _U(60)).astype(np.int64)
    selector[raw] = 0
    count = COUNTS[selector]
    count[raw] = 1
    count[raw.astype(np.int64) - 1] = 0  # the escapes themselves
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    before = np.cumsum(count) - count
    at = block * BLOCK + before - before[offsets][block]
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(len(offsets) * BLOCK, np.uint64)
    plain = np.ones(len(words), bool)
    plain[raw] = plain[raw.astype(np.int64) - 1] = False
    out[at[raw]] = words[raw]
    for s in range(1, 15):
        who = np.flatnonzero(plain & (selector == s))
        if len(who):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            values = (words[who][:, None] >> shifts) & _U((1 << int(WIDTHS[s])) - 1)
            to = at[who][:, None] + np.arange(COUNTS[s])
            inside = to < end[who][:, None]
            out[to[inside]] = values[inside]
    return out[:n]
