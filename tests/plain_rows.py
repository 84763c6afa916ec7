"""Rows that the made-up files must give, by a plain container reader and the plain decoder."""

import math
import struct

from plain_vorbis import Stream


def pages_of(content):
    at, out = 0, []
    while at < len(content):
        magic, _, flags, position, serial, _, _, n = struct.unpack("<4sBBqIIIB", content[at : at + 27])
        assert magic == b"OggS"
        sizes = content[at + 27 : at + 27 + n]
        body, at = content[at + 27 + n : at + 27 + n + sum(sizes)], at + 27 + n + sum(sizes)
        packets, start, end = [], 0, 0
        for k in sizes:
            end += k
            if k < 255:
                packets.append(body[start:end])
                start = end
        assert start == end, "made-up packets end with their page"
        out.append((serial, flags, position, packets))
    return out


def links_of(content):
    """(serial, pages, packets as (data, position of the page, ends its page, ends the stream)) of each link."""
    out = []
    for serial, flags, position, packets in pages_of(content):
        if flags & 2:
            out.append([serial, 0, []])
        out[-1][1] += 1
        for i, data in enumerate(packets):
            last = i == len(packets) - 1
            out[-1][2].append((data, position, last, last and bool(flags & 4)))
    return out


def link_row(number, link_idx, link):
    serial, pages, packets = link
    stream, position, samples, blocks, power, values = Stream(packets[0][0], packets[2][0]), None, [], 0, 0.0, 0
    for data, page, ends, last in packets[3:]:
        got = stream.decode(data)
        long = data[0] >> 1 & 1
        blocks += stream.sizes[long]
        if last and position is not None:
            got = [c[: max(0, page - position)] for c in got]
        position = page if ends else None if position is None else position + len(got[0])
        samples.append(len(got[0]))
        power += sum(x * x for c in got for x in c)
        values += sum(map(len, got))
    total, skipped = 0, None
    for i, n in enumerate(samples):
        if total <= 1000 < total + n:
            skipped = len(samples) - i, sum(samples) - 1000, 0
        total += n
    skipped = skipped or (0, 0, 1000 - total)
    size = sum(len(p[0]) for p in packets)
    return number, link_idx, serial, stream.channels, len(packets), size, pages, packets[-1][1], len(samples), blocks, total, round(
        10 * math.log10(power / values), 2
    ), *skipped


def book_rows(stream):
    for i, b in enumerate(stream.books):
        codes = sorted(b.codes)
        yield i, b.dims, len(codes), sum(n for n, _ in codes), sum(c for _, c in codes), round(sum(map(sum, b.vectors or [])), 3)
