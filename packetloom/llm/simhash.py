"""SimHash near-duplicate classes by tiled exact comparison.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64 hashes of the
document's word shingles. Two fingerprints are linked if at most ``radius`` bits differ.

Links are found among distinct fingerprints, in tiles. The 64 bits are cut into blocks; two linked
fingerprints agree on some combination of blocks, since ``radius`` differing bits spoil at most
``radius`` blocks. Each combination deals the fingerprints into tiles by the agreeing bits, so tiles
that can't hold a link are never paired, and the number of blocks follows the number of
fingerprints. Fingerprints that agree are sorted by population count and cut into tiles of ``STEP``;
two tiles are compared, by numpy's exclusive-or and bit count, only if their population counts come
within the radius of each other (in groups of up to ``SMALL`` each fingerprint is a tile). Groups larger
than ``TILE`` are first dealt over tasks by population count, pairs of parts beyond the radius left
out. A comparison passes on a spanning forest of its links, never all pairs. Classes come from
distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import arrow_map, drop_tables, free_name, materialize, table, tables_made

#: Fingerprints that agree on some blocks before they are dealt over tasks by population count.
TILE = 4096
#: Fingerprints of a tile, and of a group that is compared one by one.
STEP = 256
SMALL = 48
#: Most rounds of star contraction; it takes about the logarithm of the longest chain.
ROUNDS = 64
#: Rows whose keys are broadcast to filter documents in place; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash as a signed integer; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - np.array([len(w) + 1 for w in words]))[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (long): the fingerprint of every whole text. A null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
    return rows.mapInArrow(
        arrow_map(lambda c: {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "fp": [fingerprint(t, shingle) for t in c["text"]]}, out),
        "doc_id long, text_hash long, fp long"
    )


def block_masks(n: int, radius: int) -> list[int]:
    """Bit masks, one for each combination of blocks; any two linked fingerprints agree under one of them."""
    extra = 1 if n < 1 << 22 else 2 if n < 1 << 30 else 4
    blocks = radius + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, extra)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


class _Forest:
    """Union-find over positions in an array, with roots kept flat."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            lo, hi = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Forest over the links of one group (right None) or between two: linked fingerprints, their roots, and the number of tile pairs compared."""
    by_count = lambda f: f[np.argsort(np.bitwise_count(f), kind="stable")]
    left = by_count(left)
    right = None if right is None else by_count(right)
    every = left if right is None else np.concatenate([left, right])
    other = every if right is None else right
    forest, shift, compared = _Forest(len(every)), 0 if right is None else len(left), 0
    count, other_count = np.bitwise_count(left).astype(int), np.bitwise_count(other).astype(int)
    for at in range(0, len(left), STEP):
        rows = left[at : at + STEP]
        lo, hi = count[at] - radius, count[min(at + STEP, len(left)) - 1] + radius
        first = at if right is None else 0  # a pair within one group is compared once
        for to in range(first, len(other), STEP):
            end = min(to + STEP, len(other)) - 1
            if other_count[to] > hi:
                break
            if other_count[end] < lo:
                continue
            compared += 1
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ other[None, to : end + 1]) <= radius)
            i, j = i + at, j + to + shift
            keep = i < j
            forest.join(i[keep], j[keep])
    member = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[member], every[forest.root[member]], compared


def _compare(radius: int):  # noqa: ANN202
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, side, fp) sorted by key: each key is a tile (side 0), or two tiles."""
        held_k, held_s, held_f = np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.uint64)

        def links(k: np.ndarray, s: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, int)
            sizes = np.diff(np.append(starts, len(k)))
            a, b = [], []
            small = sizes <= SMALL
            many = np.repeat(small, sizes)
            ks, fs = k[many], f[many]
            pops = np.bitwise_count(fs).astype(np.int8)
            for d in range(1, int(sizes[small].max(initial=1))):  # all small groups at once: members d apart
                at = np.flatnonzero((ks[d:] == ks[:-d]) & (np.abs(pops[d:] - pops[:-d]) <= radius))
                at = at[np.bitwise_count(fs[at + d] ^ fs[at]) <= radius]
                a.append(fs[at])
                b.append(fs[at + d])
            if a and sum(map(len, a)):
                x, y = np.concatenate(a), np.concatenate(b)
                nodes, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
                forest = _Forest(len(nodes))
                forest.join(inv[: len(x)], inv[len(x) :])
                m = np.flatnonzero(forest.root != np.arange(len(nodes)))
                a, b = [nodes[m]], [nodes[forest.root[m]]]
            for at, n in zip(starts[~small], sizes[~small], strict=True):
                ft, st = f[at : at + n], s[at : at + n]
                two = st.any()
                x, y, _ = tile_links(ft[st == 0] if two else ft, ft[st == 1] if two else None, radius)
                a.append(x)
                b.append(y)
            if a and sum(map(len, a)):
                x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=out)

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
            held_s = np.concatenate([held_s, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)])
            held_f = np.concatenate([held_f, batch.column(2).to_numpy().view(np.uint64)])
            if len(held_k) < 1 << 18:
                continue
            cut = int(np.searchsorted(held_k, held_k[-1]))  # the last key may go on
            yield from links(held_k[:cut], held_s[:cut], held_f[:cut])
            held_k, held_s, held_f = held_k[cut:], held_s[cut:], held_f[cut:]
        yield from links(held_k, held_s, held_f)

    return run


def link_fingerprints(fps: DataFrame, n: int, radius: int) -> DataFrame:
    """a, b: links between distinct fingerprints fps (fp), a forest for each comparison."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(n, radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("m", "mask")).select(F.xxhash64("m", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > TILE).select("key")
    if hot.isEmpty():
        tiles = keyed.select("key", F.lit(0).cast("byte").alias("side"), "fp")
    else:
        hot = materialize(hot, "simhash-hot")
        tiles = keyed.join(hot, "key", "left_anti").select("key", F.lit(0).cast("byte").alias("side"), "fp").unionByName(
            _hot_tiles(keyed.join(hot, "key", "left_semi"), radius)
        )
    ordered = tiles.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_compare(radius), "a long, b long")


def _hot_tiles(rows: DataFrame, radius: int) -> DataFrame:
    """Splits large tiles by population count (and, within one count, by a hash) and pairs the parts within the radius."""
    rows = rows.withColumn("pop", F.bit_count("fp"))
    parts = rows.groupBy("key", "pop").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    rows = rows.join(parts, ["key", "pop"]).select("key", "fp", "pop", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    each = parts.select("key", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one, two = each.select("key", F.struct("pop", "part").alias("t")), each.select("key", F.struct("pop", "part").alias("u"))
    pairs = one.join(two, "key").filter((F.col("t") <= F.col("u")) & (F.abs(F.col("t.pop") - F.col("u.pop")) <= radius))
    ends = pairs.select(
        "key", F.xxhash64("key", "t", "u").alias("pair"),
        F.explode(
            F.when(F.col("t") == F.col("u"), F.array(F.struct(F.lit(0).cast("byte").alias("side"), "t.pop", "t.part"))).otherwise(
                F.array(
                    F.struct(F.lit(0).cast("byte").alias("side"), F.col("t.pop").alias("pop"), F.col("t.part").alias("part")),
                    F.struct(F.lit(1).cast("byte").alias("side"), F.col("u.pop").alias("pop"), F.col("u.part").alias("part"))
                )
            )
        ).alias("e")
    )
    ends = ends.select("key", "pair", "e.side", "e.pop", "e.part")
    return rows.join(ends, ["key", "pop", "part"]).select(F.col("pair").alias("key"), "side", "fp")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b), by large-star and small-star steps."""
    since = tables_made()
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    for _ in range(ROUNDS):
        # aggregates are written before they are joined, so that a hub's rows can be split over tasks
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = materialize(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").filter("u <> v").distinct()
        e = materialize(small, name)
        drop_tables(since, e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits), component_id (least doc_id of the class), class_root (its least fingerprint).

    One row for each input row. Null and empty texts have fingerprint zero and are linked like any
    other; rows with a null doc_id keep it and count for links, but name a class only if it has no
    other id (component_id is null then). Repeated ids are separate rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    found = components(link_fingerprints(fps.select("fp"), fps.count(), radius), "simhash-cc")
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-named")
    label = materialize(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-labels")
    return rows.join(label, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("class_root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """docs with one row for each class: that with the least doc_id, and of several with that id the one with the least text hash.

    Texts without words (null, empty) are one class. Of rows equal in id and text one stays. An empty
    table stays empty. Documents never move: the keys of the rows that go are broadcast, up to
    BROADCAST_ROWS of them.
    """
    rows = materialize(simhash_classes(docs, id_col, text_col, radius).select("doc_id", "text_hash", "component_id", "class_root"), "simhash-rows")
    texts = materialize(rows.groupBy("class_root", "component_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")), "simhash-texts")
    first = texts.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("class_root").agg(F.min("text_hash").alias("first_hash"))
    first = materialize(first, "simhash-first")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    judged = texts.join(first, "class_root").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "times", stays.alias("stays"))
    gone = materialize(judged.filter("not stays OR times > 1"), "simhash-gone")
    name = free_name(docs, "_hash")
    hashed = docs.withColumn(name, F.xxhash64(text_col)).alias("d")
    match = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k._id")) & (F.col(f"d.`{name}`") == F.col("k._text"))
    few = gone.count() <= BROADCAST_ROWS
    keys = gone.select("_id", "_text").alias("k")
    out = hashed.join(F.broadcast(keys) if few else keys, match, "left_anti").drop(name)
    repeated = gone.filter("stays")
    if not repeated.isEmpty():
        out = out.unionByName(hashed.join(repeated.select("_id", "_text").alias("k"), match, "left_semi").dropDuplicates([id_col, name]).drop(name))
    return out


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
