"""Streaming ingestion: packets that arrive over time, decoded with the half of the block before as state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.codebook import BadHeader
from packetloom.operators.decode import BadAudio
from packetloom.plans.decode import PacketDecoder
from packetloom.sources.ogg import PACKET_SCHEMA, own_packets, split_files

OUT = "file string, link_idx int, pkt_idx long, status string, samples int, position long, planar array<array<float>>"
_STATE = "ident binary, setup binary, before binary, channels int, position long"


def files_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Packets of files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return split_files(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path))


def packets_stream(spark: SparkSession, path: str) -> DataFrame:
    """Packets as they appear in Parquet files of the packet schema."""
    return spark.readStream.schema(PACKET_SCHEMA).parquet(path)


@lru_cache(maxsize=64)
def _decoder(ident: bytes, setup: bytes) -> PacketDecoder:
    return PacketDecoder.from_headers(ident, setup)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ident, setup, before, channels, position = state.get if state.exists else (None, None, None, 0, None)
    rows = []
    every = pd.concat(list(frames)).sort_values("pkt_idx")
    for r in every.itertuples():
        data = bytes(r.data)
        if r.pkt_idx < 3:
            ident, setup = (data if r.pkt_idx == 0 else ident), (data if r.pkt_idx == 2 else setup)
            continue
        status, pcm = "ok", np.zeros((0, 0), np.float32)
        try:
            d = _decoder(bytes(ident or b""), bytes(setup or b""))
            d.before = np.frombuffer(bytes(before), np.float32).reshape(channels, -1) if before is not None else None
            try:
                pcm = d.decode(data)
            finally:
                before, channels = (None, 0) if d.before is None else (np.ascontiguousarray(d.before).tobytes(), len(d.before))
        except (BadHeader, BadAudio) as e:
            status = str(e)
        n = pcm.shape[1]
        if r.last_in_stream and position is not None and not pd.isna(r.absgp_page):
            n = min(n, max(0, int(r.absgp_page) - position))
        if status == "ok" and r.last_in_page and not pd.isna(r.absgp_page):
            position = int(r.absgp_page)
        elif position is not None:
            position += n
        rows.append((key[0], key[1], r.pkt_idx, status, n, position, [c[:n].tolist() for c in pcm]))
    state.update((ident, setup, before, channels, position))
    yield pd.DataFrame(rows, columns=["file", "link_idx", "pkt_idx", "status", "samples", "position", "planar"])


def decode_stream(packets: DataFrame) -> DataFrame:
    """Decoded samples of a stream of packets; those of one link must arrive in order, over any number of batches.

    State is one link's headers, the kept half of its last block, and its position.
    """
    rows = own_packets(packets).select("file", F.col("link_idx"), "pkt_idx", "data", "absgp_page", "last_in_page", "last_in_stream")
    return rows.groupBy("file", "link_idx").applyInPandasWithState(_step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
