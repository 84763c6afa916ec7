"""Packets to headers, blocks and positioned samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import bits, vectors
from packetloom.operators.bits import BitReader, EndOfPacket
from packetloom.operators.codebook import BadHeader, PrefixTable
from packetloom.operators.decode import BadAudio, Block, decode_packet, overlap, shape_of
from packetloom.operators.headers import MAGIC, Floor0, Floor1, Ident, Setup, read_comments, read_ident, read_setup, split_extradata
from packetloom.plans import timeline
from packetloom.sources.ogg import own_packets

#: Packets that one task decodes in a row. They are led by the last TAIL packets before them, of which one is decoded again for its kept half.
BUCKET = 4096
TAIL = 16
#: Samples of an output batch, about.
CHUNK = 1 << 19


class PacketDecoder:
    """Decodes packets in order, on the caller's side."""

    def __init__(self, ident: Ident, setup: Setup) -> None:
        self.ident, self.setup, self.before = ident, setup, None

    @classmethod
    def from_headers(cls, ident: bytes, setup: bytes) -> PacketDecoder:
        head = read_ident(ident)
        return cls(head, read_setup(setup, head.channels))

    @classmethod
    def from_extradata(cls, bundle: bytes) -> PacketDecoder:
        ident, _, setup = split_extradata(bundle)
        return cls.from_headers(ident, setup)

    def reset(self) -> None:
        """As before the first packet: the next one gives no samples."""
        self.before = None

    def decode(self, data: bytes):  # noqa: ANN201
        """Samples by channel (float32) that the packet completes; raises BadAudio."""
        block: Block = decode_packet(data, self.ident, self.setup)
        before, self.before = self.before, None
        out = overlap(block, before)
        self.before = block.kept
        return out

    def prime(self, data: bytes) -> None:
        try:
            self.before = decode_packet(data, self.ident, self.setup).kept
        except BadAudio:
            return

    def sample_count(self, data: bytes) -> int:
        s = shape_of(data, self.ident, self.setup)
        return s.right - s.left


def header_packets(packets: DataFrame) -> DataFrame:
    """file, link_idx, and the ident, comment and setup packets of each link."""
    head = own_packets(packets).filter("pkt_idx < 3")
    return head.groupBy("file", "link_idx").agg(*[F.max(F.when(F.col("pkt_idx") == i, F.col("data"))).alias(n) for i, n in enumerate(("ident", "comment", "setup"))])


def _parsed(rows: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for r in b.to_pylist() for x in fn(r)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, ddl)


_IDENT = [
    ("channels", pa.int16()), ("sample_rate", pa.int64()), ("bitrate_max", pa.int32()), ("bitrate_nominal", pa.int32()), ("bitrate_min", pa.int32()),
    ("bs0", pa.int8()), ("bs1", pa.int8()), ("status", pa.string())
]
_KEY = [("file", pa.string()), ("link_idx", pa.int32())]


def _header_status(row: dict) -> tuple[str, Ident | None, Setup | None]:
    try:
        ident = read_ident(row["ident"] or b"")
        read_comments(row["comment"] or b"")
        return "ok", ident, read_setup(row["setup"] or b"", ident.channels)
    except BadHeader as e:
        return str(e), None, None


def stream_info(packets: DataFrame) -> DataFrame:
    """The ident header of each link; status is the first error of its three headers, or ok."""

    def one(r: dict) -> list[dict]:
        status = _header_status(r)[0]
        try:
            i = read_ident(r["ident"] or b"")
            values = (i.channels, i.rate, i.bitrate_max, i.bitrate_nominal, i.bitrate_min, i.bs0, i.bs1)
        except BadHeader:
            values = (None,) * 7
        return [{"file": r["file"], "link_idx": r["link_idx"], **dict(zip([n for n, _ in _IDENT], (*values, status), strict=True))}]

    return _parsed(
        header_packets(packets), one, pa.schema(_KEY + _IDENT),
        "file string, link_idx int, channels short, sample_rate long, bitrate_max int, bitrate_nominal int, bitrate_min int, bs0 byte, bs1 byte, status string"
    )


def comments(packets: DataFrame) -> DataFrame:
    """file, link_idx, vendor, pos, key, value: one row for each comment."""

    def some(r: dict) -> list[dict]:
        try:
            vendor, pairs = read_comments(r["comment"] or b"")
        except BadHeader:
            return []
        return [{"file": r["file"], "link_idx": r["link_idx"], "vendor": vendor, "pos": i, "key": k, "value": v} for i, (k, v) in enumerate(pairs)]

    schema = pa.schema([*_KEY, ("vendor", pa.string()), ("pos", pa.int32()), ("key", pa.string()), ("value", pa.string())])
    return _parsed(header_packets(packets), some, schema, "file string, link_idx int, vendor string, pos int, key string, value string")


def codebooks(packets: DataFrame) -> DataFrame:
    """file, link_idx, book, dims, entry, code_len, codeword, vq: one row for each used entry."""
    from packetloom.operators.codebook import assign

    def some(r: dict) -> list[dict]:
        setup = _header_status(r)[2]
        out = []
        for b, book in enumerate(setup.books if setup else []):
            for entry, n, code in assign(book.lengths):
                out.append(
                    {
                        "file": r["file"], "link_idx": r["link_idx"], "book": b, "dims": book.dims, "entry": entry, "code_len": n, "codeword": code,
                        "vq": None if book.vectors is None else book.vectors[entry].tolist()
                    }
                )
        return out

    schema = pa.schema(
        [
            *_KEY, ("book", pa.int32()), ("dims", pa.int32()), ("entry", pa.int32()), ("code_len", pa.int32()), ("codeword", pa.string()),
            ("vq", pa.list_(pa.float32()))
        ]
    )
    return _parsed(header_packets(packets), some, schema, "file string, link_idx int, book int, dims int, entry int, code_len int, codeword string, vq array<float>")


def setup_summary(packets: DataFrame) -> DataFrame:
    """file, link_idx, part (floor, residue, mapping, mode), idx, kind, detail: the other tables of the setup header."""

    def number_list(*values) -> str:  # noqa: ANN002
        return " ".join("-" if v is None else str(v) for v in values)

    def floor(f: Floor0 | Floor1) -> str:
        if isinstance(f, Floor0):
            return number_list(f.order, f.rate, f.map_size, f.amplitude_bits, f.amplitude_offset, *f.books)
        return number_list(f.multiplier, *f.partitions) + "; " + number_list(*f.xs)

    def some(r: dict) -> list[dict]:
        s = _header_status(r)[2]
        if not s:
            return []
        rows = [("floor", i, 0 if isinstance(f, Floor0) else 1, floor(f)) for i, f in enumerate(s.floors)]
        rows += [
            ("residue", i, x.kind, number_list(x.begin, x.end, x.partition, x.classes, x.classbook) + "; " + "; ".join(number_list(*c) for c in x.books)) for i,
            x in enumerate(s.residues)
        ]
        rows += [
            ("mapping", i, 0, "; ".join(number_list(*x) for x in ([c for pair in m.coupling for c in pair], m.mux, m.floors, m.residues))) for i,
            m in enumerate(s.mappings)
        ]
        rows += [("mode", i, int(long), str(m)) for i, (long, m) in enumerate(s.modes)]
        return [{"file": r["file"], "link_idx": r["link_idx"], "part": p, "idx": i, "kind": k, "detail": d} for p, i, k, d in rows]

    schema = pa.schema([*_KEY, ("part", pa.string()), ("idx", pa.int32()), ("kind", pa.int32()), ("detail", pa.string())])
    return _parsed(header_packets(packets), some, schema, "file string, link_idx int, part string, idx int, kind int, detail string")


def extradata(bundles: DataFrame) -> DataFrame:
    """key, status, channels, sample_rate, sizes (bytes of the three headers) of header bundles (key, bundle)."""

    def one(r: dict) -> list[dict]:
        try:
            heads = split_extradata(r["bundle"] or b"")
            ident = read_ident(heads[0])
            read_setup(heads[2], ident.channels)
            return [{"key": r["key"], "status": "ok", "channels": ident.channels, "sample_rate": ident.rate, "sizes": [len(h) for h in heads]}]
        except BadHeader as e:
            return [{"key": r["key"], "status": str(e), "channels": None, "sample_rate": None, "sizes": None}]

    schema = pa.schema([("key", pa.string()), ("status", pa.string()), ("channels", pa.int32()), ("sample_rate", pa.int64()), ("sizes", pa.list_(pa.int32()))])
    return _parsed(bundles.select("key", "bundle"), one, schema, "key string, status string, channels int, sample_rate long, sizes array<int>")


def read_symbols(rows: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """key, symbols, bits: the first n codewords of data (key, data) in the code of these lengths, up to the end of the data, and the bits they take."""

    def one(r: dict, table: PrefixTable) -> dict:
        bits, out = BitReader(r["data"] or b""), []
        try:
            while len(out) < n:
                out.append(table.read(bits))
        except EndOfPacket:
            pass
        return {"key": r["key"], "symbols": out, "bits": bits.at}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PrefixTable(lengths)
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(r, table) for r in b.to_pylist()], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("symbols", pa.list_(pa.int32())), ("bits", pa.int32())])
    return rows.select("key", "data").mapInArrow(run, "key long, symbols array<int>, bits int")


#: The first error of a link's headers, or ok, and what the first bits of its packets are read with.
_LINK_DDL = "file string, link_idx int, sample_rate long, bs0 int, bs1 int, longs array<boolean>, link_status string"


def link_table(packets: DataFrame) -> DataFrame:
    """file, link_idx, sample_rate, bs0, bs1 (exponents of the block sizes), longs (by mode: long blocks?), link_status."""

    def one(r: dict) -> list[dict]:
        status, ident, setup = _header_status(r)
        known = {"sample_rate": ident.rate, "bs0": ident.bs0, "bs1": ident.bs1, "longs": [long for long, _ in setup.modes]} if setup else {}
        return [{"file": r["file"], "link_idx": r["link_idx"], "sample_rate": None, "bs0": None, "bs1": None, "longs": None, "link_status": status} | known]

    schema = pa.schema([*_KEY, ("sample_rate", pa.int64()), ("bs0", pa.int32()), ("bs1", pa.int32()), ("longs", pa.list_(pa.bool_())), ("link_status", pa.string())])
    return _parsed(header_packets(packets), one, schema, _LINK_DDL)


def packet_kind(data: Column) -> Column:
    """audio, ident, comment, setup, or the error of a packet's first bytes."""
    first = F.hex(F.substring(data, 1, 7))
    kind = F.conv(F.substring(first, 1, 2), 16, 10).cast("int")
    named = F.create_map(*[x for k, v in ((1, "ident"), (3, "comment"), (5, "setup")) for x in (F.lit(k), F.lit(v))])[kind]
    return F.when(F.length(data) == 0, "EndOfPacket").when(kind % 2 == 0, "audio").when(
        F.substring(first, 3, 12) == MAGIC.hex().upper(), F.coalesce(named, F.lit("HeaderBadType"))
    ).otherwise("NotVorbisHeader")


def shapes(packets: DataFrame) -> DataFrame:
    """file, link_idx, pkt_idx, status, sample_rate, n, samples, position and page columns of every audio packet, from its first three bytes.

    samples are those that decoding gives, cut at the end of the stream; position is that after the
    packet, null while unknown. Packets that fail only in their body count as if they decoded. All
    is done with functions on columns; only the headers are parsed in Python.
    """
    keys = ["file", "link_idx"]
    own = own_packets(packets).filter("pkt_idx >= 3")
    heads = own.select(
        *keys, "pkt_idx", F.rpad(F.hex(F.substring("data", 1, 3)), 6, "0").alias("hex"), (8 * F.length("data")).alias("bits"), "absgp_page", "last_in_page",
        "last_in_stream"
    )
    byte = lambda i: F.conv(F.substring("hex", 2 * i + 1, 2), 16, 10).cast("long")
    rows = heads.join(link_table(packets), keys, "left").withColumn("v", byte(0) + byte(1) * 256 + byte(2) * 65536)
    rows = rows.withColumn("w", bits.ilog(F.size("longs") - 1))
    at = lambda skip, width: F.pmod(F.floor(F.col("v") / F.pow(F.lit(2), skip)), F.pow(F.lit(2), width)).cast("int")
    rows = rows.withColumn("mode", at(F.lit(1), F.col("w")))
    rows = rows.withColumn("long", F.coalesce(F.get("longs", F.col("mode")), F.lit(False)))
    known = F.when(F.coalesce("link_status", F.lit("EndOfPacket")) != "ok", F.coalesce("link_status", F.lit("EndOfPacket")))
    known = known.when(F.col("bits") == 0, "EndOfPacket").when(F.col("v") % 2 == 1, "AudioIsHeader").when(F.col("bits") < 1 + F.col("w"), "EndOfPacket")
    known = known.when(F.col("mode") >= F.size("longs"), "AudioBadFormat").when(F.col("long") & (F.col("bits") < 3 + F.col("w")), "EndOfPacket")
    rows = rows.withColumn("head", known)
    short, one = F.pow(F.lit(2), F.col("bs0")).cast("int"), F.lit(1)
    n = F.when(F.col("head").isNull(), F.when(F.col("long"), F.pow(F.lit(2), F.col("bs1"))).otherwise(F.pow(F.lit(2), F.col("bs0"))).cast("int"))
    rows = rows.withColumn("n", n).withColumn(
        "g",
        vectors.block_geometry(F.col("n"), short, F.col("long"), F.col("long") & (at(1 + F.col("w"), one) == 1), F.col("long") & (at(2 + F.col("w"), one) == 1))
    )
    good = F.col("head").isNull()
    past = Window.partitionBy(*keys).orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last(F.when(good, F.col("g.end") - F.col("g.right")), ignorenulls=True).over(past))
    rows = rows.withColumn("violates", F.col("before") > F.col("g.left_end") - F.col("g.left"))
    rows = timeline.slope_status(rows, keys, "pkt_idx", "violates", good)
    rows = rows.withColumn("status", F.coalesce("head", "status"))
    count = F.when((F.col("status") == "ok") & F.col("before").isNotNull() & ~F.col("restarts"), F.col("g.right") - F.col("g.left")).otherwise(0)
    rows = rows.withColumn("count", count)
    ends = (F.col("status") == "ok") & F.col("last_in_page") & F.col("absgp_page").isNotNull()
    rows = timeline.position(rows, keys, "pkt_idx", F.col("count"), ends, F.col("absgp_page"))
    known_before = F.lag("position").over(Window.partitionBy(*keys).orderBy("pkt_idx"))
    stay = timeline.end_trim(F.col("count"), known_before, F.col("absgp_page"), F.col("last_in_stream")).cast("int")
    return rows.select(
        *keys, "pkt_idx", "status", "sample_rate", F.coalesce("n", F.lit(0)).alias("n"), stay.alias("samples"), "position", "absgp_page", "last_in_page",
        "last_in_stream"
    )


_INFO = [
    ("status", pa.string()), ("sample_rate", pa.int64()), ("n", pa.int32()), ("samples", pa.int32()), ("position", pa.int64()), ("absgp_page", pa.int64()),
    ("last_in_page", pa.bool_()), ("last_in_stream", pa.bool_())
]
#: What the kernel is told besides: samples to drop at the front (below 0: no row, the packet only primes), and what is left to skip.
_ORDERS = [("cut", pa.int32()), ("leftover", pa.int64())]
_SHAPE_DDL = "file string, link_idx int, pkt_idx long, status string, sample_rate long, n int, samples int, position long, absgp_page long, last_in_page boolean, last_in_stream boolean"
_FLAT = pa.schema([*_KEY, ("pkt_idx", pa.int64()), *_INFO, _ORDERS[1]])


def _dealt(packets: DataFrame, info: DataFrame) -> DataFrame:
    """Audio packets by bucket, each with its row of info (if it has one) before it; a bucket is led by its link's headers and the TAIL packets before it."""
    keys = ["file", "link_idx"]
    bucket, in_bucket = F.floor((F.col("pkt_idx") - 3) / BUCKET), F.pmod(F.col("pkt_idx") - 3, F.lit(BUCKET))

    def both(rows: DataFrame, *cols: Column) -> DataFrame:
        """Each row in its own bucket (section 2), the last ones also in the next (section 1)."""
        here = F.struct(bucket.alias("bucket"), F.lit(2).alias("section"))
        there = F.struct((bucket + 1).alias("bucket"), F.lit(1).alias("section"))
        at = F.explode(F.when(in_bucket >= BUCKET - TAIL, F.array(here, there)).otherwise(F.array(here))).alias("b")
        return rows.select(*keys, "pkt_idx", *cols, at).select(*keys, "b.bucket", "b.section", "pkt_idx", "info", "data", "ident", "setup")

    none = lambda t: F.lit(None).cast(t)
    struct = "struct<" + ", ".join(f.replace(" ", ":", 1).strip() for f in [*_SHAPE_DDL.split(", ")[3:], "cut int", "leftover long"]) + ">"
    facts = both(info, F.struct(*[n for n, _ in _INFO + _ORDERS]).cast(struct).alias("info"), none("binary").alias("data"), none("binary").alias("ident"), none("binary").alias("setup"))
    audio = both(own_packets(packets).filter("pkt_idx >= 3"), none(struct).alias("info"), F.col("data"), none("binary").alias("ident"), none("binary").alias("setup"))
    used = own_packets(packets).filter("pkt_idx >= 3").select(*keys, bucket.alias("bucket")).distinct()
    head = header_packets(packets).join(used, keys).select(
        *keys, "bucket", F.lit(0).alias("section"), F.lit(-1).cast("long").alias("pkt_idx"), none(struct).alias("info"), none("binary").alias("data"), "ident",
        "setup"
    )
    rows = head.unionByName(facts).unionByName(audio).withColumn("second", F.col("info").isNull())
    tasks = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: few compressed bytes are much work, so small parts aren't to be joined
    return rows.repartition(tasks, *keys, "bucket").sortWithinPartitions(*keys, "bucket", "section", "pkt_idx", "second").drop("bucket", "second")


@lru_cache(maxsize=32)
def _decoder(ident: bytes, setup: bytes) -> PacketDecoder | None:
    try:
        return PacketDecoder.from_headers(ident, setup)
    except BadHeader:
        return None


def _planar(blocks: list[np.ndarray]) -> pa.Array:
    """List of channels of samples, built from the blocks' own memory."""
    sizes = [n for b in blocks for n in [b.shape[1]] * len(b)]
    flat = np.concatenate([b.ravel() for b in blocks]) if blocks else np.zeros(0, np.float32)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.float32, copy=False)))
    outer = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), inner)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """As to_pylist, column by column, which takes a quarter less time."""
    names = [n for n in batch.schema.names if n != "info"]
    infos = batch.column("info")
    told = infos.filter(infos.is_valid())
    fields = [n for n, _ in _INFO + _ORDERS]
    facts = (dict(zip(fields, v, strict=True)) for v in zip(*[told.field(n).to_pylist() for n in fields], strict=True))
    columns = [batch.column(n).to_pylist() for n in names]
    for valid, *values in zip(infos.is_valid().to_pylist(), *columns, strict=True):
        yield dict(zip(names, values, strict=True)) | {"info": next(facts) if valid else None}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _dealt to samples; packets without a row of info are passed over."""
    decoder: PacketDecoder | None = None
    info: dict | None = None
    told = -1
    primer: bytes | None = None
    rows: list[dict] = []
    pcm: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal rows, pcm, size
        flat = pa.RecordBatch.from_pylist(rows, schema=_FLAT)
        out = pa.RecordBatch.from_arrays([*flat.columns, _planar(pcm)], names=[*_FLAT.names, "planar"])
        rows, pcm, size = [], [], 0
        return out

    nothing = np.zeros((0, 0), np.float32)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for r in _rows(batch.slice(at, 512)):
                if r["section"] == 0:
                    decoder, info, primer = _decoder(r["ident"] or b"", r["setup"] or b""), None, None
                    if decoder:
                        decoder.reset()
                    continue
                if r["info"] is not None:
                    info, told = r["info"], r["pkt_idx"]
                    continue
                if info is None or told != r["pkt_idx"]:
                    continue
                if r["section"] == 1:  # the last packet that decodes leaves its half, one that fails at its slope none
                    if info["status"] == "ok":
                        primer = r["data"]
                    elif info["n"]:
                        primer = None
                    continue
                if primer is not None and decoder:
                    decoder.prime(primer)
                primer = None
                got, block = {k: r[k] for k in ("file", "link_idx", "pkt_idx")} | info, nothing
                cut = got.pop("cut")
                if decoder and got["status"] == "ok":
                    try:
                        block = decoder.decode(r["data"])[:, max(0, cut) : got["samples"]]
                    except BadAudio as e:
                        got["status"], block = str(e), nothing
                    got["samples"] = block.shape[1]
                elif decoder and got["n"]:
                    decoder.reset()
                if cut < 0:
                    continue
                rows.append(got)
                pcm.append(block)
                size += block.size
                if size > CHUNK:
                    yield flush()
    if rows:
        yield flush()


def _samples(packets: DataFrame, info: DataFrame) -> DataFrame:
    return _dealt(packets, info).mapInArrow(_decode, _SHAPE_DDL + ", leftover long, planar array<array<float>>")


def decode(packets: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Samples of every audio packet with its position: status, and planar (channels of floats; none for the first packet and for bad ones).

    The last packet of a link is cut to its end, if the position before it is known. Positions and
    lengths are those of shapes, computed before decoding, so samples are never shuffled. With
    fail_fast the first bad packet raises instead.
    """
    info = shapes(packets).withColumns({"cut": F.lit(0), "leftover": F.lit(0).cast("long")})
    out = _samples(packets, info).drop("leftover")
    if fail_fast:
        out = out.withColumn(
            "status",
            F.when(
                F.col("status") != "ok", F.raise_error(F.concat(F.lit("packet "), F.col("pkt_idx").cast("string"), F.lit(": "), F.col("status")))
            ).otherwise(F.col("status"))
        )
    return out


def as_i16(samples: DataFrame, interleaved: bool = False) -> DataFrame:
    """planar as 16-bit samples, or (interleaved) one array."""
    out = samples.withColumn("planar", F.transform("planar", lambda c: F.transform(c, vectors.quantize)))
    if not interleaved:
        return out
    return out.withColumn("interleaved", F.when(F.col("samples") > 0, vectors.interleave(F.col("planar"))).otherwise(F.array().cast("array<smallint>"))).drop("planar")


def skip(packets: DataFrame, n: int) -> DataFrame:
    """As decode from sample n of each link on, decoding no more than the packet before it; leftover is 0.

    A link of no more than n samples has one row with status EndOfStream and what is left to skip as leftover.
    Where to begin is found on the rows of shapes, link by link as they lie there; packets before it
    go to the kernel untold and are passed over.
    """
    keys = ["file", "link_idx"]
    whole = Window.partitionBy(*keys).orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    info = shapes(packets).withColumn("_end", F.sum("samples").over(Window.partitionBy(*keys).orderBy("pkt_idx")))
    hit = (F.col("_end") > n) & (F.col("_end") - F.col("samples") <= n)
    info = info.withColumns({
        "_at": F.max(F.when(hit, F.col("pkt_idx"))).over(whole), "_left": F.max(F.when(hit, n - (F.col("_end") - F.col("samples")))).over(whole),
        "_last": F.max("pkt_idx").over(whole)
    })
    info = info.withColumn("_from", F.coalesce(F.max(F.when((F.col("n") > 0) & (F.col("pkt_idx") < F.col("_at")), F.col("pkt_idx"))).over(whole), F.col("_at")))
    short = F.col("_at").isNull()
    told = info.filter(F.when(short, F.col("pkt_idx") == F.col("_last")).otherwise(F.col("pkt_idx") >= F.col("_from"))).withColumns({
        "cut": F.when(F.col("pkt_idx") < F.col("_at"), -1).when(F.col("pkt_idx") == F.col("_at"), F.col("_left")).otherwise(0),
        "leftover": F.when(short, n - F.col("_end")).otherwise(0), "status": F.when(short, "EndOfStream").otherwise(F.col("status")),
        "samples": F.when(short, 0).otherwise(F.col("samples"))
    })
    out = _samples(packets, told)
    unknown = [c for c in out.columns if c not in (*keys, "status", "samples", "leftover")]
    out = out.withColumns({c: F.when(F.col("status") != "EndOfStream", F.col(c)) for c in unknown})
    return out.select(*[c for c in out.columns if c != "leftover"], "leftover")


def seek(packets: DataFrame, target: int) -> DataFrame:
    """Packets of each link after the last page that ends at or before the target, with the headers."""
    own = own_packets(packets)
    page = F.when(F.col("last_in_page") & (F.col("pkt_idx") >= 3), F.col("absgp_page"))
    return own.filter("pkt_idx < 3").unionByName(timeline.seek_page(own.filter("pkt_idx >= 3"), ["file", "link_idx"], "pkt_idx", page, target))


def durations(packets: DataFrame) -> DataFrame:
    """file, packets, seconds, from the packets' first bits."""
    s = shapes(packets).groupBy("file", "link_idx").agg(F.count(F.lit(1)).alias("packets"), (F.sum("samples") / F.first("sample_rate")).alias("seconds"))
    return s.groupBy("file").agg(F.sum("packets").alias("packets"), F.sum("seconds").alias("seconds"))


@lru_cache(maxsize=8)
def _content(number: int, n_packets: int, **options: int) -> bytes:
    from packetloom.sources.synth import made_up

    return made_up(number, n_packets, **options)


def made_up_files(numbers: DataFrame, number: Column, n_packets: int = 40, **options: int) -> DataFrame:
    """path, content of made-up files, made by the tasks: one for each id of numbers (id), its content that of made_up(number); options go there."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"made-up-{i}.ogg" for i in part.column(0).to_pylist()]),
                        pa.array([_content(k, n_packets, **options) for k in part.column(1).to_pylist()], pa.binary())
                    ],
                    names=["path", "content"]
                )

    # a row of a few bytes makes a file: left as they are read, all numbers might lie in one task
    tasks = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbers.select(F.col("id").cast("long"), number.cast("long").alias("number")).repartition(tasks, "id")
    return dealt.mapInArrow(make, "path string, content binary")


def synthetic_files(spark: SparkSession, files: int = 4, n_packets: int = 40, **options: int) -> DataFrame:
    """made_up_files, one for each number below files."""
    return made_up_files(spark.range(files), F.col("id"), n_packets, **options)
