"""Bit reading, codebooks, headers and the packet kernel."""

import random
import struct

import numpy as np
import pytest

from packetloom.operators.bits import BitReader, EndOfPacket, bit_reverse, byte_mask, ilog, low_mask, packed_float, sign_extend
from packetloom.operators.codebook import BadHeader, BadTree, PrefixTable, assign, expand, lookup1_values
from packetloom.operators.decode import BadAudio, bark_cos, block_shape, db_table, decode_packet, floor1_curve, imdct, inverse_couple, overlap, render_point, shape_of, window_slope
from packetloom.operators.headers import Floor1, neighbor, read_comments, read_ident, read_setup, split_extradata
from packetloom.plans.decode import PacketDecoder
from packetloom.sources import synth


def test_bit_reads():
    bits = BitReader(bytes([0b11111100, 0b01001000, 0b11001110, 0b00000110]))
    assert [bits.read(n) for n in (4, 3, 7, 13)] == [12, 7, 17, 6969]
    assert BitReader(b"\x05vorbis"[1:]).read(8) == ord("v")
    assert BitReader(b"").read(0) == 0
    with pytest.raises(EndOfPacket):
        BitReader(b"\xff").read(9)
    b = BitReader(b"\xff\x00")
    assert (b.peek(8), b.at) == (255, 0)
    b.advance(3)
    assert b.read(5) == 31 and b.flag() is False


def test_scalars():
    assert [sign_extend(x, 8) for x in (0, 127, 128, 255)] == [0, 127, -128, -1]
    assert [ilog(x) for x in (0, 1, 2, 3, 4, 7)] == [0, 1, 2, 2, 3, 3]
    assert [low_mask(n) for n in (0, 1, 8)] == [0, 1, 255] and byte_mask(0) == 255 and byte_mask(3) == 7
    assert bit_reverse(1) == 1 << 31 and bit_reverse(bit_reverse(0x12345678)) == 0x12345678
    assert packed_float(synth.pack_float(-2.5)) == -2.5 and packed_float(788 << 21 | 1) == 1.0 and packed_float(0) == 0.0


def test_assignment():
    got = assign([2, 4, 4, 4, 4, 2, 3, 3])
    assert [c for _, _, c in got] == ["00", "0100", "0101", "0110", "0111", "10", "110", "111"]
    assert assign([]) == [] and assign([0, 1, 0]) == [(1, 1, "0")]
    for lengths, what in (([1, 1, 1], "Overspecified"), ([1, 2], "Underpopulated"), ([0, 2], "InvalidSingleEntry")):
        with pytest.raises(BadTree, match=what):
            assign(lengths)


@pytest.mark.parametrize("lengths", [[2, 4, 4, 4, 4, 2, 3, 3], [1, 2, 3, 3], [*range(1, 14), 13]])
def test_prefix_table_round_trip(lengths):
    rng, codes = random.Random(1), {e: c for e, _, c in assign(lengths)}
    picks = [rng.choice(list(codes)) for _ in range(200)]
    w = synth.BitWriter()
    for e in picks:
        for bit in codes[e]:
            w.put(int(bit), 1)
    bits, table = BitReader(w.done()), PrefixTable(lengths)
    assert [table.read(bits) for _ in picks] == picks


def test_lookup_values():
    """The integer root over a grid, by trying every number."""
    for e in [*range(60), 3**7 - 1, 3**7, 6**5 - 1, 6**5, 2**20]:
        for d in range(1, 24):
            r = lookup1_values(e, d)
            assert r**d <= e < (r + 1) ** d, (e, d)
    assert lookup1_values(7, 0) == 2**32 - 1 and lookup1_values(0, 0) == 0
    assert expand(1, 4, 2, -1.0, 2.0, False, [0, 1]).tolist() == [[-1, -1], [1, -1], [-1, 1], [1, 1]]
    assert expand(2, 2, 2, 0.0, 1.0, True, [1, 2, 3, 4]).tolist() == [[1, 3], [3, 7]]


def test_ident():
    i = read_ident(synth.ident_header(2, 44100, 8, 11))
    assert (i.channels, i.rate, i.bitrate_nominal, i.bs0, i.bs1) == (2, 44100, 112000, 8, 11)
    good = synth.ident_header()
    cases = {
        b"": "EndOfPacket", b"\x00" + good[1:]: "HeaderIsAudio", b"\x01vorbix" + good[7:]: "NotVorbisHeader", b"\x03" + good[1:]: "HeaderBadType",
        good[:7] + b"\x01" + good[8:]: "UnsupportedVorbisVersion", good[:11] + b"\x00" + good[12:]: "HeaderBadFormat", good[:-1] + b"\x00": "HeaderBadFormat",
        good[:-2] + b"\x68\x01": "HeaderBadFormat", good[:20]: "EndOfPacket",
    }
    for data, what in cases.items():
        with pytest.raises(BadHeader, match=f"^{what}$"):
            read_ident(data)


def test_comments():
    vendor, pairs = read_comments(synth.comment_header([("A", "1"), ("A", "x=y"), ("b", "")], "me", [b"none", b"\xff=1"]))
    assert vendor == "me" and pairs == [("A", "1"), ("A", "x=y"), ("b", "")]
    with pytest.raises(BadHeader, match="HeaderBadFormat"):
        read_comments(synth.comment_header([])[:-1] + b"\x00")
    with pytest.raises(BadHeader, match="Utf8DecodeError"):
        read_comments(b"\x03vorbis" + struct.pack("<I", 1) + b"\xff" + struct.pack("<I", 0) + b"\x01")


def test_setup_and_extradata():
    heads = [synth.ident_header(), synth.comment_header([]), synth.setup_header()]
    s = read_setup(heads[2], 2)
    assert (len(s.books), len(s.floors), len(s.residues), len(s.modes), s.mappings[0].coupling) == (5, 1, 1, 2, [(0, 1)])
    for cut in range(8, len(heads[2]), 7):
        with pytest.raises(BadHeader):
            read_setup(heads[2][:cut], 2)
    runs = lambda n: bytes([255] * (n // 255) + [n % 255])
    assert split_extradata(b"\x02" + runs(len(heads[0])) + runs(len(heads[1])) + b"".join(heads)) == heads
    with pytest.raises(BadHeader):
        split_extradata(b"\x01")


def test_floor_math():
    v = [0, 128, 5, 60, 5, 30]
    assert neighbor(v, 5, True) == (2, 5) and neighbor(v, 5, False) == (3, 60)
    with pytest.raises(ValueError, match="no neighbor"):
        neighbor([1, 0], 1, True)
    assert render_point(0, 10, 10, 0, 3) == 7 and render_point(0, 0, 3, 10, 2) == 6
    assert abs(db_table()[255] - 1) < 1e-6 and abs(db_table()[0] - 1.0649863e-07) < 1e-12
    assert bark_cos(64, 44100, 64)[0] == 1
    fl = Floor1([], [], [], [], [], 1, [0, 128], [0, 1])
    curve = floor1_curve(fl, [10, 200], 64)
    assert np.allclose(curve, db_table()[[10 + 190 * i // 128 for i in range(64)]])


@pytest.mark.parametrize("n", [64, 256, 2048])
def test_imdct_against_definition(n):
    x = np.random.default_rng(n).normal(size=n // 2)
    i, k = np.arange(n)[:, None], np.arange(n // 2)[None, :]
    want = (np.cos(np.pi / (n // 2) * (i + 0.5 + n / 4) * (k + 0.5)) * x).sum(axis=1)
    assert np.abs(imdct(x) - want).max() < 5e-5 * max(1, n / 256)


def test_window_and_coupling():
    w = window_slope(128)
    assert np.allclose(w**2 + w[::-1] ** 2, 1, atol=1e-6)
    m, a = np.array([1.0, 1, -1, -1]), np.array([0.5, -0.5, 0.5, -0.5])
    first, second = inverse_couple(m, a)
    assert first.tolist() == [1, 0.5, -1, -0.5] and second.tolist() == [0.5, 1, -0.5, -1]
    s = block_shape(256, 64, True, False, True)
    assert (s.left, s.left_end, s.right, s.end, s.slope) == (48, 80, 128, 256, 32)


@pytest.mark.parametrize("floor", [0, 1])
@pytest.mark.parametrize("residue", [0, 1, 2])
@pytest.mark.parametrize("channels", [1, 2])
def test_packets_decode(floor, residue, channels):
    ident, setup = read_ident(synth.ident_header(channels)), read_setup(synth.setup_header(channels, floor, residue), channels)
    before, total = None, 0
    for p in synth.audio_packets(random.Random(3), 12):
        try:
            b = decode_packet(p, ident, setup)
        except BadAudio as e:  # random bits may name a book that floor 0 doesn't have
            assert floor == 0 and str(e) == "EndOfPacket"
            before = None
            continue
        assert b.pcm.shape == (channels, shape_of(p, ident, setup).n)
        pcm = overlap(b, before)
        assert pcm.shape[1] == (0 if before is None else b.shape.right - b.shape.left)
        before, total = b.kept, total + pcm.shape[1]
    assert total > 0


def test_hand_computed_block():
    """Floor 1 of level 255 everywhere and no residue bits: silence; an unused floor: silence too."""
    ident, setup = read_ident(synth.ident_header(1)), read_setup(synth.setup_header(1), 1)
    assert not decode_packet(synth.BitWriter().put(0, 3).done(), ident, setup).pcm.any()
    w = synth.BitWriter().put(0, 2).put(1, 1).put(127, 7).put(127, 7).put(0, 40)
    assert np.isfinite(decode_packet(w.done(), ident, setup).pcm).all()


def test_audio_errors():
    ident, setup = read_ident(synth.ident_header(1)), read_setup(synth.setup_header(1), 1)
    for data, what in ((b"\x01", "AudioIsHeader"), (b"", "EndOfPacket")):
        with pytest.raises(BadAudio, match=what):
            decode_packet(data, ident, setup)
    d = PacketDecoder(ident, setup)
    long = synth.BitWriter().put(0b1110, 4).put(0, 1).done()
    short = synth.BitWriter().put(0, 3).done()
    assert d.decode(long).shape[1] == 0 and d.decode(long).shape[1] == 128
    with pytest.raises(BadAudio, match="AudioBadFormat"):  # the kept half of a long block meets a short slope
        d.decode(short)
    assert d.decode(short).shape[1] == 0 and d.decode(short).shape[1] == 32
    d.reset()
    assert d.decode(short).shape[1] == 0
