"""Writes small streams: valid headers, and packets whose payload is random bits (all trees are complete, so any bits decode)."""

from __future__ import annotations

import random
import struct

from packetloom.operators.bits import ilog
from packetloom.operators.decode import shape_of
from packetloom.operators.headers import read_ident, read_setup
from packetloom.sources.ogg import checksum


class BitWriter:
    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, x: int, n: int) -> BitWriter:
        self.value |= (x & ((1 << n) - 1)) << self.size
        self.size += n
        return self

    def done(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def pack_float(x: float) -> int:
    """A multiple of 1/16 as a packed float."""
    m = int(abs(x) * 16)
    return (1 << 31 if x < 0 else 0) | ((788 - 4) << 21) | m


def ident_header(channels: int = 2, rate: int = 44100, bs0: int = 6, bs1: int = 8, nominal: int = 112000) -> bytes:
    return b"\x01vorbis" + struct.pack("<IBIiii", 0, channels, rate, 0, nominal, 0) + bytes([bs0 | bs1 << 4, 1])


def comment_header(pairs: list[tuple[str, str]], vendor: str = "packetloom", raw: list[bytes] | None = None) -> bytes:
    entries = [f"{k}={v}".encode() for k, v in pairs] + (raw or [])
    body = struct.pack("<I", len(vendor.encode())) + vendor.encode() + struct.pack("<I", len(entries))
    return b"\x03vorbis" + body + b"".join(struct.pack("<I", len(e)) + e for e in entries) + b"\x01"


def _book(w: BitWriter, dims: int, lengths: list[int], lookup: tuple[int, float, float, int, list[int]] | None = None) -> None:
    w.put(0x564342, 24).put(dims, 16).put(len(lengths), 24).put(0, 1).put(0, 1)
    for n in lengths:
        w.put(n - 1, 5)
    if lookup is None:
        w.put(0, 4)
        return
    kind, minimum, delta, sequence, values = lookup
    w.put(kind, 4).put(pack_float(minimum), 32).put(pack_float(delta), 32).put(3, 4).put(sequence, 1)
    for v in values:
        w.put(v, 4)


def setup_header(channels: int = 2, floor: int = 1, residue: int = 2, coupling: bool = True, partition: int = 8) -> bytes:
    """Five books, one floor, one residue, a mapping for each block size's mode."""
    w = BitWriter()
    w.put(4, 8)
    _book(w, 2, [1, 2, 3, 3])  # classes of two partitions
    _book(w, 2, [3] * 7 + [4, 4], (1, -1.0, 1.0, 0, [0, 1, 2]))  # residue values
    _book(w, 1, [6] * 64)  # floor values
    _book(w, 1, [2] * 4)  # floor subclasses
    _book(w, 2, [2] * 4, (2, 0.0, 0.25, 1, [1, 2, 2, 1, 1, 1, 3, 1]))  # floor 0 coefficients
    w.put(0, 6).put(0, 16)
    w.put(0, 6).put(floor, 16)
    if floor == 0:
        w.put(4, 8).put(44100, 16).put(64, 16).put(6, 6).put(100, 8).put(0, 4).put(4, 8)
    else:
        w.put(2, 5).put(0, 4).put(1, 4)  # two partitions, of classes 0 and 1
        w.put(1, 3).put(0, 2).put(3, 8)  # class 0: two values, one book
        w.put(1, 3).put(1, 2).put(3, 8).put(0, 8).put(3, 8)  # class 1: two values, subclasses with no book and a book
        w.put(1, 2).put(7, 4)
        for x in (12, 40, 25, 90):
            w.put(x, 7)
    w.put(0, 6).put(residue, 16).put(0, 24).put(96, 24).put(partition - 1, 24).put(1, 6).put(0, 8)
    w.put(1, 3).put(0, 1).put(3, 3).put(0, 1)  # class 0: pass 0; class 1: passes 0 and 1
    w.put(1, 8).put(1, 8).put(1, 8)
    w.put(0, 6).put(0, 16).put(0, 1)
    if coupling and channels > 1:
        w.put(1, 1).put(0, 8).put(0, ilog(channels - 1)).put(1, ilog(channels - 1))
    else:
        w.put(0, 1)
    w.put(0, 2).put(0, 8).put(0, 8).put(0, 8)
    w.put(1, 6)
    for long in (0, 1):
        w.put(long, 1).put(0, 16).put(0, 16).put(0, 8)
    w.put(1, 1)
    return b"\x05vorbis" + w.done()


def audio_packets(rng: random.Random, n: int, size: int = 60, longs: list[bool] | None = None) -> list[bytes]:
    """Packets of short and long blocks with fitting window flags and random payload."""
    longs = longs or [rng.random() < 0.6 for _ in range(n)]
    out = []
    for i, long in enumerate(longs):
        w = BitWriter().put(0, 1).put(int(long), 1)
        if long:
            w.put(int(i > 0 and longs[i - 1]), 1).put(int(i + 1 < n and longs[i + 1]), 1)
        for _ in range(rng.randrange(size // 2, size)):
            w.put(rng.randrange(256), 8)
        out.append(w.done())
    return out


def page(serial: int, sequence: int, pieces: list[bytes], position: int, flags: int, open_end: bool = False) -> bytes:
    table = []
    for i, p in enumerate(pieces):
        table += [255] * (len(p) // 255)
        if not (open_end and i == len(pieces) - 1):
            table.append(len(p) % 255)
    body = b"".join(pieces)
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, position, serial, sequence, 0, len(table)) + bytes(table)
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def link(serial: int, headers: list[bytes], audio: list[bytes], per_page: int = 6, cut: int = 0) -> bytes:
    """A logical stream; positions are those of the samples, the last less cut."""
    ident = read_ident(headers[0])
    setup = read_setup(headers[2], ident.channels)
    out = [page(serial, 0, headers[:1], 0, 2), page(serial, 1, headers[1:], 0, 0)]
    at, counts = 0, []
    for i, p in enumerate(audio):
        s = shape_of(p, ident, setup)
        at += s.right - s.left if i else 0
        counts.append(at)
    for i in range(0, len(audio), per_page):
        last = i + per_page >= len(audio)
        end = min(len(audio), i + per_page)
        out.append(page(serial, 2 + i // per_page, audio[i:end], counts[end - 1] - (cut if last else 0), 4 if last else 0))
    return b"".join(out)


def made_up(number: int, n_packets: int = 40, bs0: int = 6, bs1: int = 8, size: int = 60) -> bytes:
    """A file of one or two links of packets of up to size bytes; channels, residue and coupling follow the number."""
    rng = random.Random(number)
    channels = 1 + number % 2
    headers = [
        ident_header(channels, bs0=bs0, bs1=bs1), comment_header([("TITLE", f"file {number}"), ("ARTIST", "nobody=else")]),
        setup_header(channels, residue=number % 3, coupling=number % 4 > 1)
    ]
    out = link(100 + number, headers, audio_packets(rng, n_packets, size), cut=10)
    if number % 3 == 2:
        out += link(500 + number, headers, audio_packets(rng, n_packets // 2, size))
    return out
