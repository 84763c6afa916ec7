"""Container, headers, timeline and streaming on made-up files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators.headers import read_ident, read_setup
from packetloom.plans import decode as plan
from packetloom.sources import ogg, synth
from packetloom.streaming import stream


@pytest.fixture(scope="module")
def packets(spark):
    return ogg.split_files(plan.synthetic_files(spark, 6, 30)).cache()


def reference_decode(content):
    """Plain Python: all samples of each link."""
    out = {}
    heads, decoder, position = [], None, None
    for p in ogg.packets(content):
        if p["link_idx"] is None:
            continue
        if p["pkt_idx"] == 0:
            heads, position = [], None
        if p["pkt_idx"] < 3:
            heads.append(p["data"])
            if p["pkt_idx"] == 2:
                decoder = plan.PacketDecoder.from_headers(heads[0], heads[2])
            continue
        pcm = decoder.decode(p["data"])
        if p["last_in_stream"] and position is not None:
            pcm = pcm[:, : max(0, p["absgp_page"] - position)]
        position = p["absgp_page"] if p["last_in_page"] else None if position is None else position + pcm.shape[1]
        out.setdefault(p["link_idx"], []).append(pcm)
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


def gathered(df):
    rows = sorted(df.collect(), key=lambda r: r["pkt_idx"])
    parts = [np.array(r["planar"], np.float32).reshape(len(r["planar"]), -1) for r in rows if r["samples"]]
    return np.concatenate(parts, axis=1)


def test_checksum_and_pages():
    p = synth.page(7, 0, [b"a" * 300, b"", b"b" * 255], 5, 2)
    (flags, position, serial, _, pieces, whole), = ogg.pages(b"junk" + p + b"OggS junk")
    assert (flags, position, serial, pieces, whole) == (2, 5, 7, [b"a" * 300, b"", b"b" * 255], True)
    assert list(ogg.pages(p[:-1] + b"x")) == []


def test_packet_over_pages_and_foreign_serials():
    big = bytes(range(256)) * 3
    content = synth.page(1, 0, [b"h0"], 0, 2) + synth.page(2, 0, [b"x0"], 0, 2) + synth.page(
        1, 1, [b"h1", b"h2", big[:510]], -1, 0, True
    ) + synth.page(2, 1, [b"x1"], 0, 4) + synth.page(1, 2, [big[510:], b"last"], 9, 5)
    rows = list(ogg.packets(content))
    assert [r["data"] for r in rows if r["link_idx"] == 0] == [b"h0", b"h1", b"h2", big, b"last"]
    assert [r["data"] for r in rows if r["link_idx"] is None] == [b"x0", b"x1"]
    assert [r["last_in_stream"] for r in rows if r["link_idx"] == 0] == [False] * 4 + [True]


def test_decode_matches_plain_python(spark, packets):
    got = plan.decode(packets).cache()
    for i in range(6):
        for link, want in reference_decode(synth.made_up(i, 30)).items():
            assert np.array_equal(gathered(got.filter((F.col("file") == f"made-up-{i}.ogg") & (F.col("link_idx") == link))), want)
    assert got.filter("status <> 'ok'").count() == 0


def test_buckets_do_not_matter(packets, monkeypatch):
    whole = plan.decode(packets).orderBy("file", "link_idx", "pkt_idx").select("file", "pkt_idx", "planar").collect()
    monkeypatch.setattr(plan, "BUCKET", 7)
    assert plan.decode(packets).orderBy("file", "link_idx", "pkt_idx").select("file", "pkt_idx", "planar").collect() == whole


def test_interleaved_is_planar(packets):
    a = plan.as_i16(plan.decode(packets)).orderBy("file", "link_idx", "pkt_idx").collect()
    b = plan.as_i16(plan.decode(packets), interleaved=True).orderBy("file", "link_idx", "pkt_idx").collect()
    for x, y in zip(a, b, strict=True):
        n = len(x["planar"])
        assert [y["interleaved"][j::n] for j in range(n)] == x["planar"] if x["samples"] else y["interleaved"] == []


def test_shapes_agree_with_decode(packets):
    cols = ["file", "link_idx", "pkt_idx", "samples", "status"]
    assert plan.shapes(packets).select(*cols).exceptAll(plan.decode(packets).select(*cols)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500, 1234])
def test_skip(packets, n):
    full, cut = plan.decode(packets), plan.skip(packets, n)
    for i in (0, 3):
        key = F.col("file") == f"made-up-{i}.ogg"
        assert np.array_equal(gathered(cut.filter(key)), gathered(full.filter(key))[:, n:])


def test_seek(packets):
    got = plan.seek(packets, 700).filter("pkt_idx >= 3").groupBy("file", "link_idx").agg(F.min("pkt_idx").alias("first")).collect()
    every = packets.filter("pkt_idx >= 3").collect()
    for r in got:
        ends = [p["pkt_idx"] for p in every if (p["file"], p["link_idx"]) == (r["file"], r["link_idx"]) and p["last_in_page"] and p["absgp_page"] <= 700]
        assert r["first"] == max(ends, default=2) + 1


def test_headers_as_tables(packets):
    info = {(r["file"], r["link_idx"]): r for r in plan.stream_info(packets).collect()}
    assert len(info) == 8 and all(r["status"] == "ok" for r in info.values())
    rows = plan.comments(packets).filter("file = 'made-up-1.ogg'").orderBy("pos").collect()
    assert [(r["key"], r["value"]) for r in rows] == [("TITLE", "file 1"), ("ARTIST", "nobody=else")]
    kraft = plan.codebooks(packets).groupBy("file", "link_idx", "book").agg(F.sum(F.expr("power(2.0D, -code_len)")).alias("k"))
    assert kraft.filter("k <> 1").count() == 0
    assert plan.setup_summary(packets).filter("part = 'mode'").count() == 16
    assert plan.durations(packets).filter("seconds > 0").count() == 6


def test_bad_streams(spark, packets):
    bad = packets.withColumn("data", F.when(F.col("pkt_idx") == 2, F.expr("substring(data, 1, 20)")).otherwise(F.col("data")))
    assert {r["status"] for r in plan.stream_info(bad).collect()} == {"EndOfPacket"}
    assert {r["status"] for r in plan.decode(bad).collect()} == {"EndOfPacket"}
    audio = packets.withColumn("data", F.when(F.col("pkt_idx") == 9, F.lit(b"\x01")).otherwise(F.col("data")))
    assert plan.decode(audio).filter("status = 'AudioIsHeader'").count() == 8
    with pytest.raises(Exception, match="AudioIsHeader"):
        plan.decode(audio, fail_fast=True).collect()


def test_files_source_and_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.ogg").write_bytes(synth.made_up(i, 20))
    direct = ogg.read_packets(spark, str(src))
    spark.dataSource.register(ogg.OggVorbisSource)
    assert spark.read.format("oggvorbis").load(str(src)).drop("file").exceptAll(direct.drop("file")).count() == 0
    rows = ogg.own_packets(direct).withColumn("part", F.floor(F.col("pkt_idx") / 8)).collect()
    table = tmp_path / "packets"
    (table).mkdir()
    q = stream.decode_stream(stream.packets_stream(spark, str(table))).writeStream.format("memory").queryName("decoded").outputMode("append").start()
    for part in sorted({r["part"] for r in rows}):
        batch = spark.createDataFrame([tuple(r)[:-1] for r in rows if r["part"] == part], ogg.PACKET_SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(str(table))
        q.processAllAvailable()
    q.stop()
    want = plan.decode(direct).select("file", "link_idx", "pkt_idx", "samples", "planar", "position")
    got = spark.table("decoded").select("file", "link_idx", "pkt_idx", "samples", "planar", "position")
    assert got.count() == want.count() and got.drop("position").exceptAll(want.drop("position")).count() == 0


def test_files_as_they_appear(spark, tmp_path):
    """Both ways to follow a folder give every file once."""
    src = tmp_path / "in"
    src.mkdir()
    spark.dataSource.register(ogg.OggVorbisSource)
    streams = {"followed": spark.readStream.format("oggvorbis").load(str(src)), "binary": stream.files_stream(spark, f"file://{src}")}
    started = []
    (src / "0.ogg").write_bytes(synth.made_up(0, 12))
    for name, df in streams.items():
        started.append(df.writeStream.format("memory").queryName(name).outputMode("append").start())
    for i in (1, 2):
        for q in started:
            q.processAllAvailable()
        (src / f"{i}.ogg").write_bytes(synth.made_up(i, 12))
    for q in started:
        q.processAllAvailable()
        q.stop()
    want = ogg.read_packets(spark, str(src)).drop("file")
    for name in streams:
        got = spark.table(name).drop("file")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_skip_trims_and_tells_what_is_left(packets):
    n = plan.shapes(packets).groupBy("file", "link_idx").agg(F.sum("samples").alias("n")).collect()
    most = max(r["n"] for r in n)
    got = {(r["file"], r["link_idx"]): r for r in plan.skip(packets, most).collect()}
    assert {k: r["leftover"] for k, r in got.items()} == {(r["file"], r["link_idx"]): most - r["n"] for r in n} and {r["status"] for r in got.values()} == {"EndOfStream"}
    last = plan.skip(packets, 10).filter("last_in_stream").count()
    assert last == len(n) and plan.skip(packets, 10).agg(F.sum("samples")).first()[0] == sum(max(0, r["n"] - 10) for r in n)


def test_malformed_buckets_do_not_matter(packets, monkeypatch):
    """Slope errors and bad packets around the borders of buckets leave status, samples and position as one pass over the link gives them."""
    def broken(p):
        return {
            7: b"\x01", 8: b"", 14: synth.BitWriter().put(0, 3).done(), 15: synth.BitWriter().put(0, 3).done(), 21: synth.BitWriter().put(0b0010, 4).done()
        }.get(p["pkt_idx"], p["data"])

    change = F.udf(lambda i, d: broken({"pkt_idx": i, "data": d}), "binary")
    bad = packets.withColumn("data", F.when(F.col("pkt_idx") >= 3, change("pkt_idx", "data")).otherwise(F.col("data"))).cache()
    cols = ["file", "link_idx", "pkt_idx", "status", "samples", "position", "planar"]
    want = {}
    for r in sorted(ogg.own_packets(bad).collect(), key=lambda r: (r["file"], r["link_idx"], r["pkt_idx"])):
        key = r["file"], r["link_idx"]
        if r["pkt_idx"] < 3:
            want.setdefault(key, {"heads": [], "rows": [], "position": None})["heads"].append(bytes(r["data"]))
            continue
        w = want[key]
        w.setdefault("decoder", plan.PacketDecoder.from_headers(w["heads"][0], w["heads"][2]))
        try:
            pcm, status = w["decoder"].decode(bytes(r["data"])), "ok"
            if r["last_in_stream"] and w["position"] is not None:
                pcm = pcm[:, : max(0, r["absgp_page"] - w["position"])]
            w["position"] = r["absgp_page"] if r["last_in_page"] else None if w["position"] is None else w["position"] + pcm.shape[1]
        except plan.BadAudio as e:
            pcm, status = None, str(e)
        w["rows"].append((r["pkt_idx"], status, 0 if pcm is None else pcm.shape[1], w["position"]))
    for bucket, tail in ((4096, 16), (5, 4)):
        monkeypatch.setattr(plan, "BUCKET", bucket)
        monkeypatch.setattr(plan, "TAIL", tail)
        got = plan.decode(bad).select(*cols).collect()
        for key, w in want.items():
            assert sorted((r["pkt_idx"], r["status"], r["samples"], r["position"]) for r in got if (r["file"], r["link_idx"]) == key) == w["rows"]
    assert any(s == "AudioBadFormat" for w in want.values() for _, s, _, _ in w["rows"])


def test_samples_are_not_shuffled(packets):
    text = plan.decode(packets)._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :]
    kernel = next(i for i, line in enumerate(physical.splitlines()) if "MapInArrow" in line and "planar" in line)
    assert not any("Exchange" in line for line in physical.splitlines()[:kernel])


def test_made_up_files_are_dealt_to_tasks(spark):
    """A few bytes of numbers make many files: they don't stay in the one task that reads them, and few compressed bytes in one that decodes."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = plan.made_up_files(spark.range(0, 40, 1, 1), F.col("id") % 6, 4)
    assert files.rdd.getNumPartitions() == tasks
    assert files.select(F.spark_partition_id().alias("task")).distinct().count() == tasks
    decoded = plan.decode(ogg.split_files(files)).select(F.spark_partition_id().alias("task"))
    assert decoded.distinct().count() == tasks


def test_skip_reads_shapes_once(packets):
    """Where to begin comes with the rows of shapes: no second pass over the packets, no join of samples."""
    text = plan.skip(packets, 500)._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :].splitlines()
    kernel = next(i for i, line in enumerate(physical) if "MapInArrow" in line and "planar" in line)
    assert not any("Exchange" in line or "Join" in line for line in physical[:kernel])
    assert sum("InMemoryTableScan" in line for line in physical) <= sum("InMemoryTableScan" in line for line in plan.decode(packets)._jdf.queryExecution().executedPlan().toString().splitlines())


def test_skip_begins_in_the_first_packet_with_samples(packets):
    """One sample is cut from it; the packet that primes it has no row."""
    full = plan.shapes(packets).filter("file = 'made-up-0.ogg' AND samples > 0").orderBy("pkt_idx").first()
    rows = plan.decode(packets).filter("file = 'made-up-0.ogg'")
    cut = plan.skip(packets, 1).filter("file = 'made-up-0.ogg'")
    assert cut.agg(F.min("samples")).first()[0] >= 0 and cut.agg(F.min("pkt_idx")).first()[0] == full["pkt_idx"]
    assert cut.agg(F.sum("samples")).first()[0] == rows.agg(F.sum("samples")).first()[0] - 1
