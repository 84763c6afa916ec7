"""Ogg container: files to pages and packets (RFC 3533).

Rules of our own where the format leaves room: a page with a wrong checksum is passed over and the
next capture pattern is looked for; a packet that misses its beginning or end is dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

PACKET_SCHEMA = (
    "file string, link_idx int, serial long, pkt_idx long, page_idx long, data binary, absgp_page long, "
    "first_in_stream boolean, last_in_page boolean, last_in_stream boolean"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("link_idx", pa.int32()), ("serial", pa.int64()), ("pkt_idx", pa.int64()), ("page_idx", pa.int64()), ("data", pa.binary()),
        ("absgp_page", pa.int64()), ("first_in_stream", pa.bool_()), ("last_in_page", pa.bool_()), ("last_in_stream", pa.bool_())
    ]
)


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04c11db7, most significant bit first, from 0: zlib's, with all bits mirrored."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def pages(content: bytes) -> Iterator[tuple[int, int, int, int, list[bytes], bool]]:
    """(flags, position or -1, serial, sequence, pieces, last piece is whole) of each sound page."""
    at = 0
    while (at := content.find(b"OggS", at)) >= 0:
        head = content[at : at + 27]
        if len(head) < 27:
            return
        _, version, flags, position, serial, sequence, crc, n = struct.unpack("<4sBBqIIIB", head)
        table = content[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if version or len(table) < n or end > len(content) or checksum(content[at : at + 22] + b"\0\0\0\0" + content[at + 26 : end]) != crc:
            at += 1
            continue
        pieces, start, size = [], at + 27 + n, 0
        for v in table:
            size += v
            if v < 255:
                pieces.append(content[start : start + size])
                start, size = start + size, 0
        whole = not n or table[-1] < 255
        if not whole:
            pieces.append(content[start : start + size])
        yield flags, position, serial, sequence, pieces, whole
        at = end


def packets(content: bytes) -> Iterator[dict]:
    """Packets of a file in order, with link_idx: null for packets of other serials than the link's.

    A link begins with the first packet of a stream; it ends where the first packet of another
    stream comes after the link's three headers.
    """
    open_: dict[int, bytes | None] = {}
    serial_now, link, in_link = None, -1, 0
    number: dict[int, int] = {}
    for page_idx, (flags, position, serial, _, pieces, whole) in enumerate(pages(content)):
        carried = open_.pop(serial, None)
        if flags & 1:  # the first piece goes on
            if carried is None:
                pieces = pieces[1:] if len(pieces) > 1 or whole else []
                if not pieces and not whole:
                    continue
            else:
                pieces = [carried + pieces[0], *pieces[1:]] if pieces else [carried]
        ready = pieces
        if not whole and pieces:
            open_[serial] = pieces[-1]
            ready = pieces[:-1]
        for i, data in enumerate(ready):
            first = bool(flags & 2) and i == 0
            if first and serial != serial_now and (serial_now is None or in_link >= 3):
                serial_now, link, in_link = serial, link + 1, 0
            mine = serial == serial_now
            in_link += mine
            last = i == len(ready) - 1
            number[serial] = number.get(serial, -1) + 1
            yield {
                "link_idx": link if mine else None, "serial": serial, "pkt_idx": in_link - 1 if mine else number[serial], "page_idx": page_idx, "data": data,
                "absgp_page": position if position >= 0 else None, "first_in_stream": first, "last_in_page": last, "last_in_stream": bool(flags & 4) and last,
            }


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = []
            for p in packets(content or b""):
                rows.append({"file": path, **p})
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def split_files(files: DataFrame) -> DataFrame:
    """Packets of files (path, content)."""
    return files.select("path", "content").mapInArrow(_split, PACKET_SCHEMA)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all files under a path; see PACKET_SCHEMA."""
    return split_files(spark.read.format("binaryFile").load(path))


def own_packets(all_packets: DataFrame) -> DataFrame:
    """Packets of the links, without those of foreign serials."""
    return all_packets.filter(F.col("link_idx").isNotNull())


def _listed(root_path: str) -> list[tuple[int, str]]:
    """(time of change in ns, path) of all files under a path, in that order."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(root_path) if "://" in root_path else (fs.LocalFileSystem(), root_path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = root_path.split("://")[0] + "://" if "://" in root_path else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.is_file)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _read_file(path: str) -> Iterator[tuple]:
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with files.open_input_stream(inner) as f:
        content = f.read()
    for p in packets(content):
        yield (path, *p.values())


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for _, path in _listed(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read_file(partition.path)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of their change; an offset is the last file read. A file that appears with an older time than that is passed over."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _listed(self.path)
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = ((o["changed"], o["path"]) for o in (start, end))
        return [_File(path) for changed, path in _listed(self.path) if lo < (changed, path) <= hi]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read_file(partition.path)


class OggVorbisSource(DataSource):
    """spark.dataSource.register(OggVorbisSource); spark.read (or readStream) .format("oggvorbis").load(path): one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "oggvorbis"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options["path"])
