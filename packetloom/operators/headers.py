"""The three header packets of a stream: identification, comments and setup."""

from __future__ import annotations

from dataclasses import dataclass, field

from packetloom.operators.bits import BitReader, EndOfPacket, ilog
from packetloom.operators.codebook import BadHeader, Codebook, read_codebook

MAGIC = b"vorbis"


def header_kind(data: bytes) -> int:
    """Type byte of a header packet; raises for audio and for other data."""
    if not data:
        raise BadHeader("EndOfPacket")
    if data[0] & 1 == 0:
        raise BadHeader("HeaderIsAudio")
    if data[1:7] != MAGIC:
        raise BadHeader("EndOfPacket" if MAGIC.startswith(data[1:7]) and len(data) < 7 else "NotVorbisHeader")
    return data[0]


def _expect(data: bytes, kind: int) -> None:
    got = header_kind(data)
    if got != kind:
        raise BadHeader("HeaderBadType")


@dataclass
class Ident:
    channels: int
    rate: int
    bitrate_max: int
    bitrate_nominal: int
    bitrate_min: int
    bs0: int
    bs1: int


def read_ident(data: bytes) -> Ident:
    _expect(data, 1)
    bits = BitReader(data[7:])
    try:
        if bits.read(32) != 0:
            raise BadHeader("UnsupportedVorbisVersion")
        out = Ident(bits.read(8), bits.read(32), bits.signed(32), bits.signed(32), bits.signed(32), bits.read(4), bits.read(4))
        framing = bits.read(8)
    except EndOfPacket:
        raise BadHeader("EndOfPacket") from None
    if not (6 <= out.bs0 <= out.bs1 <= 13 and framing == 1 and out.channels and out.rate):
        raise BadHeader("HeaderBadFormat")
    return out


def read_comments(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Vendor and (key, value) pairs in order; entries that aren't UTF-8 or have no `=` are left out."""
    _expect(data, 3)
    at = 7

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise BadHeader("EndOfPacket")
        at += n
        return data[at - n : at]

    number = lambda: int.from_bytes(take(4), "little")
    try:
        vendor = take(number()).decode("utf-8")
    except UnicodeDecodeError:
        raise BadHeader("Utf8DecodeError") from None
    pairs = []
    for _ in range(number()):
        raw = take(number())
        try:
            key, equals, value = raw.decode("utf-8").partition("=")
        except UnicodeDecodeError:
            continue
        if equals:
            pairs.append((key, value))
    if take(1) != b"\x01":
        raise BadHeader("HeaderBadFormat")
    return vendor, pairs


@dataclass
class Floor0:
    order: int
    rate: int
    map_size: int
    amplitude_bits: int
    amplitude_offset: int
    books: list[int]


@dataclass
class Floor1:
    partitions: list[int]
    dims: list[int]
    subclasses: list[int]
    masterbooks: list[int]
    subbooks: list[list[int]]
    multiplier: int
    xs: list[int]
    order: list[int] = field(default_factory=list)  # indices of xs by value
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)


def _below(n: int, limit: int) -> int:
    if n >= limit:
        raise BadHeader("HeaderBadFormat")
    return n


def read_floor(bits: BitReader, n_books: int) -> Floor0 | Floor1:
    kind = bits.read(16)
    if kind == 0:
        order, rate, size, width, offset = bits.read(8), bits.read(16), bits.read(16), bits.read(6), bits.read(8)
        return Floor0(order, rate, size, width, offset, [_below(bits.read(8), n_books) for _ in range(bits.read(4) + 1)])
    if kind != 1:
        raise BadHeader("HeaderBadFormat")
    partitions = [bits.read(4) for _ in range(bits.read(5))]
    dims, subclasses, masters, subbooks = [], [], [], []
    for _ in range(max(partitions, default=-1) + 1):
        dims.append(bits.read(3) + 1)
        subclasses.append(bits.read(2))
        masters.append(_below(bits.read(8), n_books) if subclasses[-1] else 0)
        subbooks.append([_below(bits.read(8) - 1, n_books) for _ in range(1 << subclasses[-1])])
    multiplier, width = bits.read(2) + 1, bits.read(4)
    if 2 + sum(dims[c] for c in partitions) > 65:
        raise BadHeader("HeaderBadFormat")
    xs = [0, 1 << width] + [bits.read(width) for c in partitions for _ in range(dims[c])]
    if len(set(xs)) < len(xs):
        raise BadHeader("HeaderBadFormat")
    floor = Floor1(partitions, dims, subclasses, masters, subbooks, multiplier, xs, sorted(range(len(xs)), key=xs.__getitem__))
    for i in range(2, len(xs)):
        floor.low.append(neighbor(xs, i, low=True)[0])
        floor.high.append(neighbor(xs, i, low=False)[0])
    return floor


def neighbor(v: list[int], at: int, low: bool) -> tuple[int, int]:
    """Index and value of the nearest smaller (or larger) value before position at; the first of equal ones."""
    found = [(x, -i) for i, x in enumerate(v[:at]) if (x < v[at] if low else x > v[at])]
    if not found:
        raise ValueError("no neighbor")
    x, i = max(found) if low else min((x, -i) for x, i in found)
    return (-i if low else i), x


@dataclass
class Residue:
    kind: int
    begin: int
    end: int
    partition: int
    classes: int
    classbook: int
    books: list[list[int | None]]  # by class and pass
    apart: bool = False  # whether no vector reaches beyond its partition: then those of a pass are added at once


def read_residue(bits: BitReader, books: list[Codebook]) -> Residue:
    kind = bits.read(16)
    if kind > 2:
        raise BadHeader("HeaderBadFormat")
    begin, end, size, classes, classbook = bits.read(24), bits.read(24), bits.read(24) + 1, bits.read(6) + 1, bits.read(8)
    if begin > end:
        raise BadHeader("HeaderBadFormat")
    cascade = []
    for _ in range(classes):
        low = bits.read(3)
        cascade.append(low | (bits.read(5) << 3 if bits.flag() else 0))
    by_class: list[list[int | None]] = []
    for c in cascade:
        row: list[int | None] = []
        for p in range(7):  # the bit of an eighth pass names no book
            row.append(_below(bits.read(8), len(books)) if c >> p & 1 else None)
            if row[-1] is not None and books[row[-1]].vectors is None:
                raise BadHeader("HeaderBadFormat")
        by_class.append([*row, None])
    _below(classbook, len(books))
    dims = [books[b].dims for row in by_class for b in row if b is not None]
    return Residue(kind, begin, end, size, classes, classbook, by_class, all(d and (kind == 0 or size % d == 0) for d in dims))


@dataclass
class Mapping:
    coupling: list[tuple[int, int]]
    mux: list[int]
    floors: list[int]
    residues: list[int]


def read_mapping(bits: BitReader, channels: int, n_floors: int, n_residues: int) -> Mapping:
    if bits.read(16):
        raise BadHeader("HeaderBadFormat")
    submaps = bits.read(4) + 1 if bits.flag() else 1
    coupling = []
    if bits.flag():
        width = ilog(channels - 1)
        for _ in range(bits.read(8) + 1):
            m, a = bits.read(width), bits.read(width)
            if m == a or m >= channels or a >= channels:
                raise BadHeader("HeaderBadFormat")
            coupling.append((m, a))
    if bits.read(2):
        raise BadHeader("HeaderBadFormat")
    mux = [_below(bits.read(4), submaps) for _ in range(channels)] if submaps > 1 else [0] * channels
    floors, residues = [], []
    for _ in range(submaps):
        bits.read(8)
        floors.append(_below(bits.read(8), n_floors))
        residues.append(_below(bits.read(8), n_residues))
    return Mapping(coupling, mux, floors, residues)


@dataclass
class Setup:
    books: list[Codebook]
    floors: list[Floor0 | Floor1]
    residues: list[Residue]
    mappings: list[Mapping]
    modes: list[tuple[bool, int]]  # long block?, mapping


def read_setup(data: bytes, channels: int) -> Setup:
    _expect(data, 5)
    bits = BitReader(data[7:])
    try:
        books = [read_codebook(bits) for _ in range(bits.read(8) + 1)]
        if any([bits.read(16) for _ in range(bits.read(6) + 1)]):
            raise BadHeader("HeaderBadFormat")
        floors = [read_floor(bits, len(books)) for _ in range(bits.read(6) + 1)]
        residues = [read_residue(bits, books) for _ in range(bits.read(6) + 1)]
        mappings = [read_mapping(bits, channels, len(floors), len(residues)) for _ in range(bits.read(6) + 1)]
        modes = []
        for _ in range(bits.read(6) + 1):
            long = bits.flag()
            if bits.read(16) or bits.read(16):
                raise BadHeader("HeaderBadFormat")
            modes.append((long, _below(bits.read(8), len(mappings))))
        if not bits.flag():
            raise BadHeader("HeaderBadFormat")
    except EndOfPacket:
        raise BadHeader("EndOfPacket") from None
    return Setup(books, floors, residues, mappings, modes)


def split_extradata(data: bytes) -> list[bytes]:
    """The three headers of a bundle: byte 2, two lengths as runs of 255, then the packets."""
    if not data or data[0] != 2:
        raise BadHeader("HeaderBadFormat")
    at, sizes = 1, []
    for _ in range(2):
        n = 0
        while True:
            if at >= len(data):
                raise BadHeader("EndOfPacket")
            n += data[at]
            at += 1
            if data[at - 1] < 255:
                break
        sizes.append(n)
    if at + sum(sizes) > len(data):
        raise BadHeader("EndOfPacket")
    return [data[at : at + sizes[0]], data[at + sizes[0] : at + sum(sizes)], data[at + sum(sizes) :]]
