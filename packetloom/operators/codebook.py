"""Codebooks: codeword assignment, prefix decoding, and lookup vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from packetloom.operators.bits import BitReader, EndOfPacket, ilog


class BadHeader(Exception):
    """A header that can't be decoded; the message is its status."""


class BadTree(Exception):
    """Overspecified, Underpopulated or InvalidSingleEntry."""


def assign(lengths: list[int]) -> list[tuple[int, int, str]]:
    """(entry, length, codeword) of the used entries: each takes the leftmost free codeword of its length, in entry order.

    At most one node is free at each depth: taking a codeword below a free node leaves the right
    siblings on the way down. No entries: no codewords. A single entry must have length 1.
    """
    used = [(i, n) for i, n in enumerate(lengths) if n]
    if len(used) == 1:
        if used[0][1] != 1:
            raise BadTree("InvalidSingleEntry")
        return [(used[0][0], 1, "0")]
    free: dict[int, str] = {0: ""}
    out = []
    for entry, n in used:
        depth = max((d for d in free if d <= n), default=None)
        if depth is None:
            raise BadTree("Overspecified")
        code = free.pop(depth)
        for d in range(depth + 1, n + 1):
            free[d] = code + "1"
            code += "0"
        out.append((entry, n, code))
    if used and free:
        raise BadTree("Underpopulated")
    return out


class PrefixTable:
    """Decodes codewords with one table for short codes and a dictionary for the rest."""

    WIDTH = 10

    def __init__(self, lengths: list[int]) -> None:
        codes = assign(lengths)
        self.empty, self.single = not codes, codes[0][0] if len(codes) == 1 else None
        self.longest = max((n for _, n, _ in codes), default=0)
        self.width = min(self.WIDTH, self.longest)
        self.mask, self.plain = (1 << self.width) - 1, self.single is None and not self.empty
        self.short: list[tuple[int, int] | None] = [None] * (1 << self.width)
        self.long: dict[tuple[int, int], int] = {}
        for entry, n, code in codes:
            low_first = int(code[::-1], 2)  # the first bit read is the top of the tree
            if n <= self.width:
                for k in range(low_first, 1 << self.width, 1 << n):
                    self.short[k] = (entry, n)
            else:
                self.long[n, low_first] = entry

    def read(self, bits: BitReader) -> int:
        if self.plain:  # as below with peek and advance, without their calls
            at = bits.at
            got = self.short[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & self.mask]
            if got:
                if at + got[1] > bits.size:
                    raise EndOfPacket
                bits.at = at + got[1]
                return got[0]
        if self.single is not None:
            bits.read(1)
            return self.single
        if self.empty:
            raise EndOfPacket
        window = bits.peek(self.longest)
        for n in range(self.width + 1, self.longest + 1):
            entry = self.long.get((n, window & ((1 << n) - 1)))
            if entry is not None:
                bits.advance(n)
                return entry
        raise EndOfPacket

    def read_many(self, bits: BitReader, n: int) -> list[int]:
        """The next n codewords, or those up to the end of the packet."""
        out: list[int] = []
        if not self.plain:
            try:
                while len(out) < n:
                    out.append(self.read(bits))
            except EndOfPacket:
                pass
            return out
        data, short, mask, size, at = bits.data, self.short, self.mask, bits.size, bits.at
        while len(out) < n:
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 32], "little") >> (at & 7)
            stop = (at & ~7) + 256 - self.width  # beyond that the window may lack bits
            while at <= stop and len(out) < n:
                got = short[window & mask]
                if not got:  # a long codeword
                    bits.at = at
                    try:
                        out.append(self.read(bits))
                    except EndOfPacket:
                        return out
                    at = bits.at
                    break
                if at + got[1] > size:
                    bits.at = at
                    return out
                out.append(got[0])
                window >>= got[1]
                at += got[1]
        bits.at = at
        return out


def lookup1_values(entries: int, dims: int) -> int:
    """Greatest r with r to the power dims at most entries; without dimensions, 2**32 - 1 (0 for no entries)."""
    if dims == 0:
        return 0xFFFFFFFF if entries else 0
    r = int(round(entries ** (1 / dims))) + 1
    while r**dims > entries:
        r -= 1
    return r


def expand(kind: int, entries: int, dims: int, minimum: float, delta: float, sequence: bool, values: list[int]) -> np.ndarray:
    """Vector of every entry: kind 1 takes digits of the entry number in base len(values), kind 2 values in order."""
    scaled = np.array(values, np.float64) * delta + minimum
    if kind == 1:
        base = len(values)
        digit = (np.arange(entries)[:, None] // np.array([base**k for k in range(dims)], dtype=object)[None, :] % base).astype(int) if base else np.zeros((entries, dims), int)
        out = scaled[digit] if base else np.zeros((entries, dims))
    else:
        out = scaled.reshape(entries, dims)
    return (out.cumsum(axis=1) if sequence else out).astype(np.float32)


@dataclass
class Codebook:
    dims: int
    lengths: list[int]
    vectors: np.ndarray | None
    table: PrefixTable

    def read_vector(self, bits: BitReader) -> np.ndarray | None:
        """The vector of the next codeword; None if the book maps no values."""
        entry = self.table.read(bits)
        return None if self.vectors is None else self.vectors[entry]


def read_codebook(bits: BitReader) -> Codebook:
    if bits.read(24) != 0x564342:
        raise BadHeader("HeaderBadFormat")
    dims, entries, ordered = bits.read(16), bits.read(24), bits.flag()
    lengths: list[int] = []
    if ordered:
        n = bits.read(5) + 1
        while len(lengths) < entries:
            count = bits.read(ilog(entries - len(lengths)))
            if len(lengths) + count > entries or n > 32 and count:
                raise BadHeader("HeaderBadFormat")
            lengths += [n] * count
            n += 1
            if n > 64:
                raise BadHeader("HeaderBadFormat")
    else:
        sparse = bits.flag()
        for _ in range(entries):
            lengths.append(bits.read(5) + 1 if not sparse or bits.flag() else 0)
    kind = bits.read(4)
    if kind > 2:
        raise BadHeader("HeaderBadFormat")
    vectors = None
    if kind:
        minimum, delta = bits.packed_float(), bits.packed_float()
        width, sequence = bits.read(4) + 1, bits.flag()
        n = lookup1_values(entries, dims) if kind == 1 else entries * dims
        if n * width > bits.size - bits.at:
            raise BadHeader("HeaderBadFormat" if n == 0xFFFFFFFF else "EndOfPacket")
        vectors = expand(kind, entries, dims, minimum, delta, sequence, [bits.read(width) for _ in range(n)])
    try:
        return Codebook(dims, lengths, vectors, PrefixTable(lengths))
    except BadTree as e:
        raise BadHeader("HeaderBadFormat") from e
