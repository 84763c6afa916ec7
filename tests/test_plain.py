"""The packet kernel against a second decoder written from the specification."""

import random

import numpy as np
import pytest
from plain_vorbis import Stream

from packetloom.operators.decode import BadAudio
from packetloom.plans.decode import PacketDecoder
from packetloom.sources import synth


@pytest.mark.parametrize("floor", [0, 1])
@pytest.mark.parametrize("residue", [0, 1, 2])
@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("partition", [8, 7])
def test_same_samples(floor, residue, channels, partition):
    """All kinds of floor and residue; a partition of 7 is no multiple of the vectors' 2 dimensions."""
    heads = synth.ident_header(channels), synth.setup_header(channels, floor, residue, partition=partition)
    plain, ours = Stream(*heads), PacketDecoder.from_headers(*heads)
    samples = 0
    for p in synth.audio_packets(random.Random(11), 8 if floor else 60):
        try:
            got = ours.decode(p)
        except BadAudio:  # random bits may name a book that floor 0 doesn't have
            assert floor == 0
            plain.half = ours.before = None
            continue
        want = np.array(plain.decode(p)).reshape(got.shape)
        if np.abs(want).max(initial=0) > 1e30:  # random bits of floor 0 may leave the range of a float
            continue
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5 * max(1, np.abs(want).max(initial=0)))
        samples += np.count_nonzero(want)
    assert samples > 0 or (floor, channels) == (0, 2)  # two channels of random bits seldom both name a book


def test_fixed_rows():
    """The rows in queries.py are those of the plain reader and decoder."""
    from plain_rows import book_rows, link_row, links_of

    from packetloom import queries

    rows = lambda text: [tuple(float(x) for x in line.strip("(), ").split(", ")) for line in text.strip().splitlines()]
    contents = {k: links_of(synth.made_up(k)) for k in range(6)}
    assert rows(queries.LINKS) == [link_row(k, i, link) for k, links in contents.items() for i, link in enumerate(links)]
    for links in contents.values():
        for _, _, packets in links:
            assert rows(queries.BOOKS) == list(book_rows(Stream(packets[0][0], packets[2][0])))
