"""Simple-8b: unsigned integers packed in 64-bit words.

The upper four bits of a word are its selector, which says how many values
the other 60 bits hold and how wide each is, the first value lowest.
Values are coded in lanes of 128, each beginning with a new word, so that
all lanes of a block are coded and decoded at once. A value that needs more
than 60 bits is an escape: a word with selector 0, the value itself in a
list beside the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE = 128
# Values in a word, by selector; each is 60 // count bits wide. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDE = 60
_SELECTOR = np.zeros(WIDE + 1, np.uint64)
_SELECTOR[COUNTS[:0:-1]] = np.arange(len(COUNTS) - 1, 0, -1, dtype=np.uint64)
_BITS_16 = np.array([int(x).bit_length() for x in range(1 << 16)], np.uint8)


@dataclass
class Block:
    count: int
    words: np.ndarray  # uint64
    lanes: np.ndarray  # int32: index of the first word of each lane
    escapes: np.ndarray  # uint64, in order


def _widths(values: np.ndarray) -> np.ndarray:
    if not len(values) or int(values.max()) < 1 << 16:
        return _BITS_16[values.astype(np.int64)]
    widths = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        large = rest >= np.uint64(1 << step)
        widths += large.astype(np.uint8) * np.uint8(step)
        rest = np.where(large, rest >> np.uint64(step), rest)
    return widths + (rest > 0)


def encode(values: np.ndarray) -> Block:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    lanes = -(-n // LANE)
    if not n:
        return Block(0, np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
    # a row for each lane, zeros behind it so that a word may look past the end
    rows = np.zeros((lanes, LANE + WIDE), np.uint64)
    widths = np.zeros((lanes, LANE + WIDE), np.uint8)
    flat = np.zeros(lanes * LANE, np.uint64)
    flat[:n] = values
    rows[:, :LANE] = flat.reshape(lanes, LANE)
    widths[:, :LANE] = _widths(flat).reshape(lanes, LANE)
    rows, widths = rows.ravel(), widths.ravel()
    take = _fitting(widths)
    # follow the words of all lanes at once
    at = np.arange(lanes, dtype=np.int64) * (LANE + WIDE)
    ends = at + LANE
    ends[-1] = at[-1] + n - (lanes - 1) * LANE
    begins = np.zeros(len(rows), bool)
    while len(at):
        begins[at] = True
        at = at + np.maximum(take[at], 1)
        inside = at < ends
        at, ends = at[inside], ends[inside]
    first = np.flatnonzero(begins)
    count = take[first]
    words = _SELECTOR[count] << np.uint64(60)
    for c in np.unique(count[count > 0]).tolist():
        own = np.flatnonzero(count == c)
        held = np.zeros(len(own), np.uint64)
        for k in range(c):
            held |= rows[first[own] + k] << np.uint64(k * (60 // c))
        words[own] |= held
    per_lane = np.bincount(first // (LANE + WIDE), minlength=lanes)
    starts = np.zeros(lanes, np.int32)
    starts[1:] = np.cumsum(per_lane)[:-1]
    return Block(n, words, starts, rows[first[count == 0]])


def _fitting(widths: np.ndarray) -> np.ndarray:
    """How many values from each place on fit in one word; 0 where not even one does."""
    n = len(widths)
    highest, take, reach = widths.copy(), (widths <= 60).astype(np.uint8), 1
    for count in COUNTS[:0:-1].tolist()[1:]:
        while reach < count:
            highest[: n - reach] = np.maximum(highest[: n - reach], widths[reach:])
            reach += 1
        fits = highest <= 60 // count
        fits[n - count + 1 :] = False
        if not fits.any():
            break
        take[fits] = count
    return take


def decode(block: Block) -> np.ndarray:
    words, n = block.words, block.count
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    begins = ends - counts
    lane = np.repeat(np.arange(len(block.lanes)), np.diff(np.append(block.lanes, len(words))))
    begins = begins - begins[block.lanes][lane] + lane * (LANE + WIDE)
    room = np.zeros(len(block.lanes) * (LANE + WIDE), np.uint64)
    for selector in np.unique(selectors[selectors > 0]).tolist():
        own = np.flatnonzero(selectors == selector)
        count = int(COUNTS[selector])
        width = 60 // count
        mask, held, place = np.uint64((1 << width) - 1), words[own], begins[own]
        for k in range(count):
            room[place + k] = (held >> np.uint64(k * width)) & mask
    room[begins[selectors == 0]] = block.escapes
    return room.reshape(-1, LANE + WIDE)[:, :LANE].ravel()[:n]
