"""Elias-Fano sequences and the n-gram trie made of them, in one memory-mapped file.

A monotone sequence of n numbers below u is stored as its low bits, packed, and its
high bits in unary, about 2 + log2(u / n) bits a number. A sparse directory has the
value and the bit at which each block of BLOCK numbers begins, so a search decodes
only the blocks that it lands in.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 15
FLOOR = 14.0  # quantised log10 probabilities lie in [-FLOOR, 0]
ABSENT = 65535


def quantise(logp: np.ndarray) -> np.ndarray:
    """log10 probabilities as 16-bit codes on a square-root scale, finest near 0; ABSENT is left out."""
    return np.rint(np.sqrt(np.clip(-logp, 0, FLOOR) / FLOOR) * (ABSENT - 1)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return -FLOOR * (code / (ABSENT - 1)) ** 2


class EliasFano:
    """A non-decreasing sequence of unsigned 63-bit integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, firsts: np.ndarray, starts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.firsts, self.starts = n, low_bits, low, high, firsts, starts

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(1, np.int64))
        bits = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1)
        where = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(where[-1]) + 1, np.bool_)
        unary[where] = True
        low = []
        for a in range(0, n, BLOCK):
            wide = np.unpackbits(values[a : a + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            low.append(np.packbits(wide[:, 64 - bits :]))  # a block's bits end at a byte, as BLOCK is a multiple of 8
        return cls(n, bits, np.concatenate(low), np.packbits(unary), values[::BLOCK].copy(), np.r_[where[::BLOCK], where[-1] + 1])

    def block(self, k: int) -> np.ndarray:
        """The numbers of block k."""
        a, b = k * BLOCK, min(self.n, (k + 1) * BLOCK)
        s, e = int(self.starts[k]), int(self.starts[k + 1])
        ones = np.flatnonzero(np.unpackbits(self.high[s // 8 : (e + 7) // 8])[s % 8 : s % 8 + e - s]) + s
        out = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = a * self.low_bits // 8
            bits = np.unpackbits(self.low[at : at + (b - a) * self.low_bits // 8 + 1], count=(b - a) * self.low_bits).reshape(b - a, self.low_bits)
            wide = np.zeros((b - a, 64), np.uint8)
            wide[:, 64 - self.low_bits :] = bits
            out |= np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        return out

    def decode(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.firsts))]) if self.n else np.zeros(0, np.uint64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The index of each of the sorted distinct `wanted`, or -1: a successor search, block by block."""
        out = np.full(len(wanted), -1, np.int64)
        if self.n and len(wanted):
            block = np.maximum(np.searchsorted(self.firsts, wanted, "right") - 1, 0)
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(wanted)]):
                held, k = self.block(int(block[a])), int(block[a])
                at = np.searchsorted(held, wanted[a:b])
                hit = held[np.minimum(at, len(held) - 1)] == wanted[a:b]
                out[a:b][hit] = at[hit] + k * BLOCK
        return out

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """The numbers at sorted indices, block by block."""
        out = np.zeros(len(wanted), np.uint64)
        if len(wanted):
            block = wanted // BLOCK
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(wanted)]):
                out[a:b] = self.block(int(block[a]))[wanted[a:b] % BLOCK]
        return out

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.firsts, self.starts

    @classmethod
    def of(cls, head: np.ndarray, *arrays: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), *arrays)


class Trie:
    """Contexts, monotone pointers to their successors, and quantised smoothed probabilities.

    Level 1 holds the sorted context ids and for each a pointer to where its successors
    begin in level 2. There the successor ids of a context, sorted, stand on top of the
    last number of the context before, so that the whole level is monotone. A look-up
    finds the context, follows its pointers to the range of its successors, takes the
    base from the number before the range, and searches the successor relative to it.
    Ids are kept whole, so no two pairs are ever taken for one another.
    """

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """Sorted context ids, pointers (one more), successor ids of each context in order, a code for each; every context has a successor."""
        last = successors[pointers[1:] - 1].astype(np.int64) + 1
        base = np.cumsum(last) - last
        arrays: list[np.ndarray] = []
        for level in (contexts, pointers, successors + np.repeat(base, np.diff(pointers))):
            arrays += EliasFano.encode(level).parts
        arrays.append(codes.astype(np.uint16))
        self.file = tempfile.TemporaryFile()  # without a name: it goes with the process
        offsets = []
        for a in arrays:
            self.file.write(bytes(-self.file.tell() % 8))
            offsets.append(self.file.tell())
            self.file.write(np.ascontiguousarray(a).tobytes())
        self.file.write(b"\0")
        self.file.flush()
        self.bytes = self.file.tell()
        held = np.memmap(self.file, np.uint8, "r")
        views = [held[o : o + a.nbytes].view(a.dtype) for o, a in zip(offsets, arrays)]
        self.contexts, self.pointers, self.successors = (EliasFano.of(*views[i : i + 5]) for i in (0, 5, 10))
        self.codes = views[15]

    def find(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of pairs, ABSENT where unknown: sorted distinct contexts, how many pairs each has, and their sorted distinct successors."""
        out = np.full(len(successors), ABSENT, np.uint16)
        rank = self.contexts.find(contexts.astype(np.uint64))
        held = rank >= 0
        known = rank[held]
        start, end = self.pointers.at(known).astype(np.int64), self.pointers.at(known + 1).astype(np.int64)
        base = np.where(start > 0, self.successors.at(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0)
        top = self.successors.at(end - 1).astype(np.int64)
        where = np.flatnonzero(np.repeat(held, lengths))
        wanted = successors[where].astype(np.int64) + np.repeat(base, lengths[held])
        inside = wanted <= np.repeat(top, lengths[held])
        at = self.successors.find(wanted[inside].astype(np.uint64))
        out[where[inside][at >= 0]] = self.codes[at[at >= 0]]
        return out

    def close(self) -> None:
        self.contexts = self.pointers = self.successors = self.codes = None
        self.file.close()
