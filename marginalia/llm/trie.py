"""An n-gram trie of Elias-Fano levels in a memory-mapped file.

A level holds the words that follow the nodes of the level above. Its sequence
is monotone: a node's words are sorted, and each is raised by its node's number
times the range of words (words are relative to their context). Pointers, a
monotone sequence too, tell where each node's words begin. A word is found by
successor search within its context's range.

A sequence in Elias-Fano form is its numbers' low bits, packed, and their high
bits in unary. Both are read in place: one number is a select on the unary part
(a rank directory with a count for each 64 bits, then the place in a machine
word) and a few bytes of the packed part. A successor search over a wide range
begins at the first number of equal high bits.

Each node has the log10 of its n-gram's add-one smoothed probability, up to the
corpus's common factor, quantised to steps of 1/STEP.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import U64

STEP = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the j-th one of a byte, at 8 * byte + j.
PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8).reshape(-1)
ALL, TOPS, LOWS = U64(2**64 - 1), U64(0x8080808080808080), U64(0x0101010101010101)
BLOCK, NARROW = 1 << 18, 16


def select64(x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Place of the j-th one in each 64-bit number: counts of bytes summed within the number, then a table."""
    s = x - ((x >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * LOWS  # byte k: ones of bytes 0 to k
    byte = np.bitwise_count(((j * LOWS | TOPS) - s) & TOPS).astype(U64) << U64(3)
    rest = j - (((s << U64(8)) >> byte) & U64(255))
    return byte + PLACE[((x >> byte) & U64(255)) << U64(3) | rest]


def quantise(count: np.ndarray) -> np.ndarray:
    """Counts as steps of log10(count + 1)."""
    return np.minimum(np.rint(np.log10(count + 1.0) * STEP), 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """Counts of codes; exact up to some 400, and within 1/STEP in log10 above."""
    return np.rint(10.0 ** (code.astype(np.float64) / STEP) - 1.0)


class Sequence:
    """A non-decreasing sequence of 64-bit numbers in a slice of a mapped file."""

    @staticmethod
    def write(values: np.ndarray, file) -> tuple[int, ...]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> U64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        bits[high] = 1
        upper = np.packbits(bits, bitorder="little")
        ones = bits.reshape(-1, 64).sum(1)
        at = file.tell()
        file.write(upper.tobytes())
        file.write((np.cumsum(ones) - ones).astype(np.uint32).tobytes())
        file.write((np.cumsum(64 - ones) - (64 - ones)).astype(np.uint32).tobytes())
        if low and n:
            # each word takes the numbers that begin in it, and the rest of one that began before
            part, at_bit = values & U64((1 << low) - 1), np.arange(n, dtype=np.int64) * low
            word, shift = at_bit >> 6, (at_bit & 63).view(U64)
            lows = np.zeros(n * low // 64 + 1, U64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lows[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift.view(np.int64) + low > 64)
            lows[word[over] + 1] |= part[over] >> (U64(64) - shift[over])
            file.write(lows.tobytes())
        file.write(bytes(24 - file.tell() % 8))
        return at, n, low, len(upper), file.tell()

    def __init__(self, raw: np.ndarray, at: int, n: int, low: int, upper: int, end: int):
        self.n, self.low = n, low
        ranks = at + upper
        self.upper = raw[at:ranks].view(U64)
        self.ones = raw[ranks : ranks + upper // 2].view(np.uint32)
        self.zeros = raw[ranks + upper // 2 : ranks + upper].view(np.uint32)
        packed = raw[ranks + upper : end]
        # a machine word from any byte on; write leaves room for the last
        self.lows = np.lib.stride_tricks.as_strided(packed[: len(packed) // 8 * 8].view(U64), (max(0, len(packed) - 8),), (1,))

    def _select(self, i: np.ndarray, ranks: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place in the unary part of each i-th one (flip 0) or zero (flip ALL)."""
        block = np.searchsorted(ranks, i.astype(np.uint32), "right") - 1
        return (block << 6) + select64(self.upper[block] ^ flip, (i - ranks[block]).view(U64)).view(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = (self._select(i, self.ones, U64(0)) - i).view(U64) << U64(self.low)
        if self.low:
            bit = i * self.low
            out |= (self.lows[bit >> 3] >> (bit & 7).view(U64)) & U64((1 << self.low) - 1)
        return out

    def _first(self, high: np.ndarray) -> np.ndarray:
        """The number of values with less than these high bits."""
        out = np.full(len(high), self.n, np.int64)
        most = len(self.upper) * 64 - self.n  # zeros of the unary part
        out[high <= 0] = 0
        on = np.flatnonzero((high > 0) & (high <= most))
        out[on] = np.minimum(self._select(high[on] - 1, self.zeros, ALL) - (high[on] - 1), self.n)
        return out

    def successor(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first position in [lo, hi) that holds no less, or hi; and whether it holds that value."""
        lo = np.broadcast_to(np.asarray(lo, np.int64), len(values)).copy()
        hi = np.broadcast_to(np.asarray(self.n if hi is None else hi, np.int64), len(values)).copy()
        if not self.n:
            return lo, np.zeros(len(values), bool)
        high = lambda on: np.minimum(values[on] >> U64(self.low), U64(2**62)).view(np.int64)
        wide = np.flatnonzero(hi - lo > NARROW)
        if len(wide):
            lo[wide] = np.minimum(np.maximum(lo[wide], self._first(high(wide))), hi[wide])
        # most are found where their range, or their high bits, begin
        got, inside = self[np.minimum(lo, self.n - 1)], lo < hi
        equal = inside & (got == values)
        on = np.flatnonzero(inside & (got < values))
        lo[on] += 1
        near = 2  # few numbers share their high bits, so the next ones are tried before the range is halved
        while len(on := on[lo[on] < hi[on]]):
            if near == 0:
                hi[on] = np.maximum(np.minimum(hi[on], self._first(high(on) + 1)), lo[on])
                on = on[lo[on] < hi[on]]
            at = lo[on] if near > 0 else lo[on] + hi[on] >> 1
            got, want = self[at], values[on]
            less = got < want
            lo[on[less]] = at[less] + 1
            hi[on[~less]] = at[~less]
            equal[on[~less]] = got[~less] == want[~less]
            near -= 1
        return lo, equal


class Trie:
    """Levels of (parent, word, count), sorted and distinct: parent is a node of the level above (None for the first).

    Words after a node are below 2**bits.
    """

    def __init__(self, levels: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]], bits: int = 32):
        self.bits = U64(bits)
        self.file = tempfile.TemporaryFile()  # noqa: SIM115 - has no name, so nothing is left behind
        plan, above = [], 0
        for parent, word, count in levels:
            pointers = None
            if parent is not None:
                pointers = Sequence.write(np.searchsorted(parent, np.arange(above + 1)).astype(U64), self.file)
                word = parent.astype(U64) << self.bits | word
            words = Sequence.write(word, self.file)
            codes = self.file.tell()
            self.file.write(quantise(count).tobytes() + bytes(-2 * len(count) % 8))
            plan.append((pointers, words, codes))
            above = len(word)
        self.file.flush()
        raw = np.asarray(np.memmap(self.file, np.uint8, "r"))
        self.pointers = [Sequence(raw, *p) if p else None for p, _, _ in plan]
        self.words = [Sequence(raw, *w) for _, w, _ in plan]
        self.codes = [raw[c : c + 2 * w[1]].view(np.uint16) for _, w, c in plan]

    def find(self, level: int, node: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        """The node of each word after a node of the level above, or -1; after -1 there is none."""
        out = np.full(len(word), -1, np.int64)
        words, pointers = self.words[level], self.pointers[level]
        asked = np.arange(len(word)) if pointers is None else np.flatnonzero(node >= 0)
        for i in range(0, len(asked), BLOCK):
            on = asked[i : i + BLOCK]
            if pointers is None:
                at, there = words.successor(word[on])
            else:
                lo, hi = pointers[node[on]].view(np.int64), pointers[node[on] + 1].view(np.int64)
                at, there = words.successor(node[on].view(U64) << self.bits | word[on], lo, hi)
            out[on[there]] = at[there]
        return out

    def code(self, level: int, node: np.ndarray) -> np.ndarray:
        """Quantised probabilities of nodes; 0 for -1."""
        out = np.zeros(len(node), np.uint16)
        out[node >= 0] = self.codes[level][node[node >= 0]]
        return out
