"""Repeated passages of a set of strings, by merging Burrows-Wheeler transforms.

The strings are dealt into shards. Each shard's suffixes are sorted and give its transform: of each suffix in order, the
m symbols before it (four, or two where there are too many different fours to count). The transforms are merged by
refining an interleave, a vector that says from which shard each row of the merged order comes. It is right for the first
d symbols; a stable counting sort by the transforms' symbols, read in the order of the interleave, makes it right for
d + m. Suffixes are not compared or sorted again: the rows of a shard keep
their order. With each step the borders between rows that differ in their first symbols are carried along, so that after
step d every block is an interval of suffixes with a common prefix of d symbols.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the suffixes' first sort looks at; interleaves begin with them.
FIRST = 8


class Shard:
    """Strings of symbols from 1, each ended by 0, with their suffixes in order (of equal ones the first first)."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        begins = np.r_[0, ends[:-1] + 1]
        #: Of each position: the symbols before its string's end.
        self.left = np.repeat(ends, ends - begins + 1) - np.arange(n)
        key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
        padded = np.r_[symbols, np.zeros(FIRST, symbols.dtype)]
        for j in range(FIRST):
            s = padded[j : j + n]
            key = key << np.uint64(8) | np.where(alive, s, 0).astype(np.uint64)
            alive &= s != 0
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        new = np.r_[True, self.key[1:] != self.key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        d = FIRST
        rows = np.flatnonzero(~(new & np.r_[new[1:], True]))
        while d < depth and len(rows):
            at = order[rows]
            inside = self.left[at] >= d
            follow = np.where(inside, rank[np.minimum(at + d, n - 1)] + 1, 0)
            both = rank[at] << 32 | follow
            by = np.argsort(both, kind="stable")
            at, both = at[by], both[by]
            order[rows] = at
            new = np.r_[True, both[1:] != both[:-1]]
            rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            rows = rows[~(new & np.r_[new[1:], True])]
            d *= 2
        self.order = order
        before = np.arange(-1, n - 1)
        before[begins] = ends
        self.codes, at = np.zeros(n, np.uint32), order
        for j in range(4):
            at = before[at]
            self.codes |= symbols[at].astype(np.uint32) << np.uint32(8 * j)


def transforms(shards: list[Shard]) -> tuple[list[np.ndarray], int]:
    """Of each shard: what stands before each suffix, as 16-bit numbers in the order of the symbols; and of how many
    symbols that is."""
    codes = np.concatenate([s.codes for s in shards])
    known, at = np.unique(codes, return_inverse=True)
    step = 4
    if len(known) > 1 << 16:
        at, step = codes & np.uint32(0xFFFF), 2
    return np.split(at.astype(np.uint16), np.cumsum([len(s.order) for s in shards])[:-1]), step


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block): the shards' rows (counted over all shards) in merged order, and of each the number of its block.

    Rows of a block have their first `depth` symbols in common; depth is FIRST and a multiple of four.
    """
    sizes = [len(s.order) for s in shards]
    before, step = transforms(shards)
    key = np.concatenate([s.key for s in shards])
    by = np.argsort(key, kind="stable")
    key = key[by]
    # of each row: its block, and in the lowest bits its shard
    state = np.cumsum(np.r_[0, key[1:] != key[:-1]], dtype=np.int32) << 3 | np.repeat(np.arange(len(shards), dtype=np.int32), sizes)[by]
    symbol = np.empty(len(by), np.uint16)
    for d in range(FIRST, depth, step):
        source = (state & 7).astype(np.uint8)
        for k, own in enumerate(before):
            symbol[source == k] = own
        by = np.argsort(symbol, kind="stable")  # 16 bits: a counting sort
        new, state = symbol[by], state[by]
        block = state >> 3
        border = new[1:] != new[:-1]
        border |= block[1:] != block[:-1]
        np.cumsum(border, out=block[1:])
        block[0] = 0
        state &= 7
        state |= block << 3
    source, rows, first = state & 7, np.empty(len(by), np.int64), 0
    for k, size in enumerate(sizes):
        rows[source == k] = np.arange(first, first + size)
        first += size
    return rows, state >> 3


def repeated(strings: list[bytes], depth: int, n_shards: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, block) of each place where `depth` symbols begin that begin at another place too; equal blocks
    have equal symbols. At most eight shards; depth is FIRST and a multiple of four."""
    n_shards = max(1, min(n_shards, len(strings)))
    size = np.array([len(s) + 1 for s in strings])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)  # no byte of UTF-8
    ends = np.cumsum(size) - 1
    closing = np.zeros(len(text), bool)
    closing[ends] = True
    present = np.zeros(256, bool)
    present[text[~closing]] = True
    code = np.zeros(256, np.uint8)
    alphabet = int(present.sum()) + 1
    if alphabet > 256:
        raise ValueError("the strings use all 256 bytes")
    code[present] = np.arange(1, alphabet)
    symbols = np.where(closing, 0, code[text]).astype(np.uint8)
    cut = np.searchsorted(ends, np.linspace(0, len(text), n_shards + 1)[1:-1])
    borders = np.unique(np.r_[0, ends[cut] + 1, len(text)])
    shards = [Shard(symbols[a:b], depth) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
    rows, block = merged(shards, depth)
    position = np.concatenate([s.order + a for s, a in zip(shards, borders[:-1], strict=True)])[rows]
    left = np.concatenate([s.left for s in shards])[position]
    same = block[1:] == block[:-1]
    many = (np.r_[False, same] | np.r_[same, False]) & (left >= depth)
    position, block = position[many], block[many]
    string = np.searchsorted(ends, position)
    return string, position - (ends[string] - size[string] + 1), block
