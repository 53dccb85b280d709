"""Canonical Huffman codes of limited length, and bit blocks with checkpoints."""

from __future__ import annotations

import numpy as np

#: Longest code: a decoder's table of 2^17 entries stays in a processor's cache. A vocabulary must be smaller.
LONGEST = 17
#: A block's bit offset is noted at every so many ids.
STRIDE = 128


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each symbol's code, 0 for symbols that don't occur, by package-merge.

    Least in total bits among all prefix codes of at most `longest` bits.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        n = int(np.count_nonzero(flags[:take]))
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: in order of length, then of symbol, each follows the one before."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for s, n in zip(order.tolist(), lengths[order].tolist()):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes end to end, and the bit offset of every STRIDE-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    both = (codes << np.uint64(8) | lengths.astype(np.uint64))[ids]
    n = (both & np.uint64(255)).view(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    # A code lies in one 32-bit word or two: seen as 64 bits that begin with its first word.
    value = (both >> np.uint64(8)) << (64 - (at & 31) - n).view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    # Codes that begin in one word don't overlap, so they add up without a carry.
    sums = np.add.reduceat(value >> np.uint64(32), first), np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    out[word[first]] += sums[0]
    out[word[first] + 1] += sums[1]
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], at[::STRIDE].astype(np.uint32)


class Decoder:
    """All prefixes of `longest` bits, with the symbol that each begins with and its length."""

    def __init__(self, lengths: np.ndarray, longest: int = LONGEST):
        self.longest = longest
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        times = 1 << (longest - lengths[order].astype(np.int64))
        #: The symbol, then 8 bits for its length.
        self.table = np.ones(1 << longest, np.uint32)
        self.table[: times.sum()] = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order], times)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of each block (payload, checkpoints, number of ids), all stretches between checkpoints in step."""
        if not blocks:
            return []
        sizes = np.array([len(p) + 8 for p, _, _ in blocks])
        base = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(p + bytes(8) for p, _, _ in blocks), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        bit = np.concatenate([8 * b + c.astype(np.int64) for b, (_, c, _) in zip(base, blocks)])
        left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for _, c, n in blocks])
        order = np.argsort(-left, kind="stable")
        bit, counts = bit[order], np.searchsorted(-left[order], -np.arange(STRIDE), side="left")
        out = np.zeros((STRIDE, len(bit)), np.uint32)
        mask = np.uint32((1 << self.longest) - 1)
        for k in range(STRIDE):
            n = counts[k]  # the stretches of more than k ids come first
            if not n:
                break
            b = bit[:n]
            found = self.table[window[b >> 3] >> (32 - self.longest - (b & 7)).astype(np.uint32) & mask]
            out[k, :n] = found
            b += found & np.uint32(255)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        flat, ids, row = (out >> np.uint32(8)).T[place].ravel(), [], 0
        for _, c, n in blocks:
            ids.append(flat[row * STRIDE : row * STRIDE + n])
            row += len(c)
        return ids
