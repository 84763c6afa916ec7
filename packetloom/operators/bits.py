"""Bit reader for packets: fields are stored least significant bit first."""

from __future__ import annotations

import math


class EndOfPacket(Exception):
    """A read went past the last bit."""


class BitReader:
    """Reads a packet; each read looks at the bytes that hold its bits alone, so its time doesn't grow with the packet."""

    __slots__ = ("at", "data", "size")

    def __init__(self, data: bytes) -> None:
        self.data, self.size, self.at = data, 8 * len(data), 0

    def read(self, n: int) -> int:
        """Unsigned field of n bits; no bits: 0, nothing consumed."""
        at, end = self.at, self.at + n
        if end > self.size:
            raise EndOfPacket
        self.at = end
        return int.from_bytes(self.data[at >> 3 : (end + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        return sign_extend(self.read(n), n)

    def flag(self) -> bool:
        return self.read(1) == 1

    def packed_float(self) -> float:
        return packed_float(self.read(32))

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end; nothing consumed."""
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def advance(self, n: int) -> None:
        if self.at + n > self.size:
            raise EndOfPacket
        self.at += n


def sign_extend(value: int, bits: int) -> int:
    return value - (1 << bits) if bits and value >> (bits - 1) & 1 else value


def low_mask(n: int) -> int:
    return (1 << n) - 1


def byte_mask(n: int) -> int:
    """As low_mask, but 0 stands for a whole byte."""
    return (1 << n) - 1 if n else 255


def ilog(x: int) -> int:
    """Position of the highest set bit, from 1; 0 for 0."""
    return x.bit_length()


def bit_reverse(x: int) -> int:
    return int(f"{x & 0xFFFFFFFF:032b}"[::-1], 2)


def packed_float(raw: int) -> float:
    """Sign in bit 31, exponent (less 788) in bits 21 to 30, mantissa below."""
    mantissa = raw & 0x1FFFFF
    return math.ldexp(-mantissa if raw >> 31 else mantissa, ((raw >> 21) & 0x3FF) - 788)
