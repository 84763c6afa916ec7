"""Decodes one audio packet to its block, without looking at other packets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

from packetloom.operators.bits import BitReader, EndOfPacket, ilog
from packetloom.operators.headers import Floor0, Floor1, Ident, Mapping, Residue, Setup


class BadAudio(Exception):
    """A packet that can't be decoded; the message is its status."""


@dataclass
class Shape:
    """Window geometry of a block of n samples: what is new starts at left, the half kept for the next block is right to end."""

    n: int
    left: int
    left_end: int
    right: int
    end: int
    slope: int  # length of the left slope


def block_shape(n: int, short: int, long: bool, prev_long: bool, next_long: bool) -> Shape:
    left, left_end, right, end = 0, n // 2, n // 2, n
    if long and not prev_long:
        left, left_end = n // 4 - short // 4, n // 4 + short // 4
    if long and not next_long:
        right, end = 3 * n // 4 - short // 4, 3 * n // 4 + short // 4
    return Shape(n, left, left_end, right, end, left_end - left)


@cache
def window_slope(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * np.sin(np.pi / 2 * (np.arange(n) + 0.5) / n) ** 2).astype(np.float32)


@cache
def _twiddles(n: int) -> tuple[np.ndarray, np.ndarray]:
    half = n // 2
    shift = 0.5 + half / 2
    return np.exp(-1j * np.pi * shift * np.arange(half) / half), np.exp(-1j * np.pi * (np.arange(n) + shift) / n)


def imdct(x: np.ndarray) -> np.ndarray:
    """n values from n / 2: y[i] = sum of x[k] cos(pi / (n/2) (i + 1/2 + n/4) (k + 1/2)), by one complex FFT of n."""
    n = 2 * len(x)
    before, after = _twiddles(n)
    with np.errstate(over="ignore", invalid="ignore"):
        return (np.fft.fft(x * before, n) * after).real.astype(np.float32)


@cache
def db_table() -> np.ndarray:
    """256 floor values, even steps of decibels from 1e-7 * 10**(7/256) to 1."""
    return (10.0 ** (7 * (np.arange(256) + 1) / 256 - 7)).astype(np.float32)


@cache
def bark_cos(n: int, rate: int, size: int) -> np.ndarray:
    """cos of the omega of each of n spectral lines on a bark scale of size steps."""
    bark = lambda x: 13.1 * np.arctan(0.00074 * x) + 2.24 * np.arctan(0.0000000185 * x * x) + 0.0001 * x
    at = np.floor(bark(rate / (2.0 * n) * np.arange(n)) * size / bark(0.5 * rate))
    return np.cos(np.pi * np.minimum(size - 1, at) / size).astype(np.float32) if size else np.ones(n, np.float32)


def floor0_curve(cosines: np.ndarray, amplitude: int, fl: Floor0, n: int) -> np.ndarray:
    omega = bark_cos(n, fl.rate, fl.map_size).astype(np.float64)
    values, where = np.unique(omega, return_inverse=True)
    odd, even = cosines[1 : fl.order : 2], cosines[0 : fl.order : 2]
    if fl.order % 2:
        p, q = 1 - values**2, np.full(len(values), 0.25)
    else:
        p, q = (1 - values) / 2, (1 + values) / 2
    for c in odd:
        p = p * 4 * (c - values) ** 2
    for c in even:
        q = q * 4 * (c - values) ** 2
    level = amplitude * fl.amplitude_offset / ((1 << fl.amplitude_bits) - 1)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        curve = np.exp(0.11512925 * (level / np.sqrt(p + q) - fl.amplitude_offset))
    return np.minimum(curve, np.finfo(np.float32).max)[where].astype(np.float32)


def read_floor0(bits: BitReader, fl: Floor0, setup: Setup, n: int) -> np.ndarray | None:
    amplitude = bits.read(fl.amplitude_bits)
    if amplitude == 0:
        return None
    number = bits.read(ilog(len(fl.books)))
    if number >= len(fl.books):
        raise BadAudio("EndOfPacket")  # undecodable
    if fl.order < 2:
        raise BadAudio("AudioBadFormat")
    found: list[float] = []
    last = 0.0
    while len(found) < fl.order:
        v = setup.books[fl.books[number]].read_vector(bits)
        if v is None or not len(v):
            raise BadAudio("EndOfPacket")
        found += (v + last).tolist()
        last += float(v[-1])
    return floor0_curve(np.cos(np.array(found[: fl.order])), amplitude, fl, n)


def render_point(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    step = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 + step if y1 >= y0 else y0 - step


def read_floor1_values(bits: BitReader, fl: Floor1, setup: Setup) -> list[int] | None:
    if not bits.flag():
        return None
    width = ilog((256, 128, 86, 64)[fl.multiplier - 1] - 1)
    ys = [bits.read(width), bits.read(width)]
    for c in fl.partitions:
        sub = fl.subclasses[c]
        chosen = setup.books[fl.masterbooks[c]].table.read(bits) if sub else 0
        for _ in range(fl.dims[c]):
            book = fl.subbooks[c][chosen & ((1 << sub) - 1)]
            chosen >>= sub
            ys.append(setup.books[book].table.read(bits) if book >= 0 else 0)
    return ys


def floor1_curve(fl: Floor1, ys: list[int], n: int) -> np.ndarray:
    """Predicts each point from its neighbours, then draws lines through the points that differ."""
    limit = (256, 128, 86, 64)[fl.multiplier - 1]
    used, final = [True, True], [ys[0], ys[1]]
    for i in range(2, len(fl.xs)):
        lo, hi = fl.low[i - 2], fl.high[i - 2]
        predicted = render_point(fl.xs[lo], final[lo], fl.xs[hi], final[hi], fl.xs[i])
        above, below, v = limit - predicted, predicted, ys[i]
        room = 2 * min(above, below)
        if v == 0:
            used.append(False)
            final.append(predicted)
            continue
        used[lo] = used[hi] = True
        used.append(True)
        if v >= room:
            final.append(v - below + predicted if above > below else predicted - v + above - 1)
        else:
            final.append(predicted - (v + 1) // 2 if v % 2 else predicted + v // 2)
    final = [min(max(y, 0), limit - 1) for y in final]
    points = [(fl.xs[i], final[i] * fl.multiplier) for i in fl.order if used[i]]
    inside = [p for p in points if p[0] < n]
    ends = [*points[1:], (points[-1][0] + 1, points[-1][1])][: len(inside)]  # beyond the last point the line is level
    lines = [(x0, y0, x1 - x0, abs(y1 - y0), 1 if y1 >= y0 else -1) for (x0, y0), (x1, y1) in zip(inside, ends, strict=True)]
    stops = [*[p[0] for p in inside[1:]], n]
    x0, y0, width, height, sign = np.array(lines).repeat([b - p[0] for p, b in zip(inside, stops, strict=True)], axis=0).T
    return db_table()[y0 + sign * (height * (np.arange(n) - x0) // width)]


def read_residue(bits: BitReader, res: Residue, setup: Setup, used: list[bool], n: int) -> list[np.ndarray]:
    """One vector for each channel of a submap; ends quietly at the end of the packet."""
    ch = len(used)
    if res.kind == 2:
        if not any(used):
            return [np.zeros(n, np.float32) for _ in used]
        flat = _read_vectors(bits, res, setup, [True], n * ch)[0]
        return [flat[j::ch] for j in range(ch)]
    return _read_vectors(bits, res, setup, used, n)


def _read_vectors(bits: BitReader, res: Residue, setup: Setup, used: list[bool], n: int) -> list[np.ndarray]:
    out = [np.zeros(n, np.float32) for _ in used]
    begin, end = min(res.begin, n), min(res.end, n)
    parts = (end - begin) // res.partition
    classbook = setup.books[res.classbook]
    per_word = classbook.dims
    if parts == 0:
        return out
    if per_word == 0:
        raise BadAudio("AudioBadFormat")
    classes = [[0] * (parts + per_word) for _ in used]
    for step in range(8):
        books = [None if row[step] is None else setup.books[row[step]] for row in res.books]
        if step and not any(books):
            continue
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        ended, at = False, 0
        try:
            while at < parts:
                if step == 0:
                    for j, u in enumerate(used):
                        if u:
                            classes[j][at : at + per_word] = class_digits(classbook.table.read(bits), res.classes, per_word)
                for at in range(at, min(at + per_word, parts)):
                    for j, u in enumerate(used):
                        c = classes[j][at]
                        if not u or not (book := books[c]):
                            continue
                        if not res.apart:
                            _read_partition(bits, res, book, out[j], begin + at * res.partition)
                            continue
                        wanted = res.partition // book.dims
                        entries = book.table.read_many(bits, wanted)
                        if len(entries) < wanted:
                            _add(res, book, out[j], begin + at * res.partition, entries, wanted)
                            raise EndOfPacket
                        if (j, c) in found:
                            found[j, c][0].append(at)
                            found[j, c][1].extend(entries)
                        else:
                            found[j, c] = [at], entries
                at += 1
        except EndOfPacket:
            ended = True
        for (j, c), (places, entries) in found.items():
            v = books[c].vectors[entries].reshape(len(places), -1, books[c].dims)
            v = (v.transpose(0, 2, 1) if res.kind == 0 else v).reshape(len(places), -1)
            out[j][begin : begin + parts * res.partition].reshape(parts, res.partition)[slice(None) if len(places) == parts else places, : v.shape[1]] += v
        if ended:
            break
    return out


@lru_cache(maxsize=1 << 16)
def class_digits(word: int, base: int, n: int) -> list[int]:
    """The last n digits of a word, most significant first."""
    return [word // base**i % base for i in range(n - 1, -1, -1)]


def _read_partition(bits: BitReader, res: Residue, book, out: np.ndarray, at: int) -> None:  # noqa: ANN001
    """Reads the codewords of a partition, then adds their vectors at once; those read before the packet ends count."""
    size, dims = res.partition, book.dims
    if not dims:
        return
    strided = res.kind == 0
    room = size // dims if strided else (len(out) - at) // dims
    # whole vectors: the last of kinds 1 and 2 may reach beyond the partition, but one that reaches beyond the end is read and dropped
    wanted = room if strided else min(-(-size // dims), room + 1)
    entries = book.table.read_many(bits, wanted)
    _add(res, book, out, at, entries, room)
    if len(entries) < wanted:
        raise EndOfPacket


def _add(res: Residue, book, out: np.ndarray, at: int, entries: list[int], room: int) -> None:  # noqa: ANN001
    """Adds the vectors of up to room entries of a partition."""
    if n := min(len(entries), room):
        found = book.vectors[entries[:n]]
        if res.kind == 0:
            for j in range(book.dims):
                out[at + j * room : at + j * room + n] += found[:, j]
        else:
            out[at : at + n * book.dims] += found.ravel()


def inverse_couple(m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square-polar magnitude and angle to two channels."""
    first = np.where(m > 0, np.where(a > 0, m, m + a), np.where(a > 0, m, m - a))
    second = np.where(m > 0, np.where(a > 0, m - a, m), np.where(a > 0, m + a, m))
    return first.astype(np.float32), second.astype(np.float32)


@dataclass
class Block:
    shape: Shape
    pcm: np.ndarray  # channels x n

    @property
    def fresh(self) -> np.ndarray:
        return self.pcm[:, self.shape.left : self.shape.right]

    @property
    def kept(self) -> np.ndarray:
        return self.pcm[:, self.shape.right : self.shape.end]


def read_start(bits: BitReader, ident: Ident, setup: Setup) -> tuple[Mapping, Shape]:
    """Mode and window flags at the head of a packet."""
    try:
        if bits.flag():
            raise BadAudio("AudioIsHeader")
        mode = bits.read(ilog(len(setup.modes) - 1))
        if mode >= len(setup.modes):
            raise BadAudio("AudioBadFormat")
        long, mapping = setup.modes[mode]
        prev, after = (bits.flag(), bits.flag()) if long else (False, False)
    except EndOfPacket:
        raise BadAudio("EndOfPacket") from None
    n, short = 1 << (ident.bs1 if long else ident.bs0), 1 << ident.bs0
    return setup.mappings[mapping], block_shape(n, short, long, prev, after)


def shape_of(data: bytes, ident: Ident, setup: Setup) -> Shape:
    """The window geometry of a packet, from its first bits."""
    return read_start(BitReader(data[:3]), ident, setup)[1]


def decode_packet(data: bytes, ident: Ident, setup: Setup) -> Block:
    bits = BitReader(data)
    mapping, shape = read_start(bits, ident, setup)
    half = shape.n // 2
    floors: list[np.ndarray | None] = []
    for c in range(ident.channels):
        fl = setup.floors[mapping.floors[mapping.mux[c]]]
        try:
            if isinstance(fl, Floor0):
                floors.append(read_floor0(bits, fl, setup, half))
            else:
                ys = read_floor1_values(bits, fl, setup)
                floors.append(None if ys is None else floor1_curve(fl, ys, half))
        except EndOfPacket:
            floors.append(None)
    used = [f is not None for f in floors]
    for m, a in mapping.coupling:
        if used[m] or used[a]:
            used[m] = used[a] = True
    spectra: list[np.ndarray] = [np.zeros(half, np.float32)] * ident.channels
    for s, r in enumerate(mapping.residues):
        mine = [c for c in range(ident.channels) if mapping.mux[c] == s]
        for c, v in zip(mine, read_residue(bits, setup.residues[r], setup, [used[c] for c in mine], half), strict=True):
            spectra[c] = v
    for m, a in reversed(mapping.coupling):
        spectra[m], spectra[a] = inverse_couple(spectra[m], spectra[a])
    pcm = [imdct(f.astype(np.float64) * v) if f is not None else np.zeros(shape.n, np.float32) for f, v in zip(floors, spectra, strict=True)]
    return Block(shape, np.stack(pcm))


def overlap(block: Block, before: np.ndarray | None) -> np.ndarray:
    """Samples that a block completes: none without a half before it."""
    s = block.shape
    if before is None:
        return block.pcm[:, :0]
    n = before.shape[1]
    if n > s.slope:
        raise BadAudio("AudioBadFormat")
    out = block.fresh.copy()
    w = window_slope(s.slope)
    out[:, :n] = out[:, :n] * w[:n] + before * w[s.slope - n :][::-1]
    return out
