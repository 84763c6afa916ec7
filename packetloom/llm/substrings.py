"""Substring dedup by repeated-phrase automata.

A word is removed if a window of WINDOW words that covers it also starts somewhere else in the
corpus. Each window is filed under its anchor, the least hash of the ANCHOR-word runs in it; equal
windows have equal anchors, and consecutive windows mostly share one, so a document files a segment
for every ten words or so.

1. A census counts the places of every anchor. Only anchors with two or more can hold a repeat.
2. Every document is cut into segments (the words of consecutive windows with one anchor), kept if
   their anchor may recur. The recurring anchors travel as a bit set of bounded size, which may let
   other segments through but loses none. Equal segments of a batch are one row with a list of
   places. Anchors with very many places are dealt by window instead, so no anchor gathers in one task.
3. Distinct segments, with their number but without their places, go to their anchor's shard. There
   windows are counted, which confirms the recurring passages (runs of windows with two or more
   places); the passages are compiled into Aho-Corasick automata over word numbers and the segments
   streamed through them. The occurrences, verified by the words' hashes, give each segment its spans.
4. Spans meet the places of their segment, and by the texts' hashes the texts, of which the words are removed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import byte_slices, materialize, table

WINDOW = 35
ANCHOR = 16
#: Most bits of a set that travels to all tasks.
MAX_BITS = 1 << 28
#: Anchors with more places than this, or than a 10,000th of all, are dealt by window (at most 10,000 anchors then).
HOT = 1_000
#: Bytes that stand for a word: 48 bits of its hash.
WORD = 6
#: Bytes of distinct segments that a task gathers before it hands them on.
HELD_BYTES = 16 << 20
#: Windows of one segment, and pattern words of one automaton, at most about.
MAX_RUN = 64
MAX_PATTERN_WORDS = 200_000

_U64 = np.uint64
_M1, _M2 = _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F)


class _Ids(dict):
    """64-bit numbers of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split: ASCII white space only


def text_key(text: str | None) -> tuple[int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = xxhash.xxh64_intdigest(raw)
    return _signed(h), zlib.crc32(raw)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(31))) * _M2
    return h ^ (h >> _U64(29))


def _slide(v: np.ndarray, n: int, pick) -> np.ndarray:  # noqa: ANN001
    """pick (np.minimum or np.maximum) over every n consecutive values."""
    k = 1
    while 2 * k <= n:
        v = pick(v[:-k], v[k:])
        k *= 2
    return pick(v[: len(v) - (n - k)], v[n - k :]) if n > k else v


def grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of every ANCHOR (a power of two) consecutive words."""
    k = 1
    while k < ANCHOR:
        ids = _mix(ids[:-k] * _M1 + ids[k:])
        k *= 2
    return ids


def window_anchors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors at all of their places."""
    g, per = grams(ids), WINDOW - ANCHOR + 1
    anchor = _slide(g, per, np.minimum)
    # a place is one whose hash is the anchor of some window over it
    padded = np.concatenate([np.zeros(per - 1, _U64), anchor, np.zeros(per - 1, _U64)])
    return anchor, g[g == _slide(padded, per, np.maximum)]


def runs_of(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one anchor, none above MAX_RUN."""
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(anchor)))
    if len(size) and size.max() > MAX_RUN:
        parts = [(f + d, min(MAX_RUN, n - d)) for f, n in zip(first.tolist(), size.tolist(), strict=True) for d in range(0, n, MAX_RUN)]
        return np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return first, size


def _bit_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & _U64(bits - 1)).astype(np.int64), (_mix(keys) >> _U64(64 - bits.bit_length() + 1)).astype(np.int64)


def bit_set(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of keys (one long column), of 16 bits a key, MAX_BITS at most; made by tasks, one for each stretch of bits."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * max(1, n) - 1).bit_length()))
    stretches = max(1, bits >> 20)
    each = bits // stretches

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _bit_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U64), bits)
            at = np.unique(np.concatenate([a, c]))
            yield pa.RecordBatch.from_arrays([pa.array(at // each), pa.array(at % each)], names=["stretch", "bit"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            s, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(s).tolist():
                held.setdefault(k, np.zeros(each, np.uint8))[at[s == k]] = 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["stretch", "bits"]
        )

    got = keys.mapInArrow(places, "stretch long, bit long").repartition("stretch").mapInArrow(build, "stretch long, bits binary").collect()  # MAX_BITS / 8 bytes at most
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out[r["stretch"] * each // 8 : (r["stretch"] + 1) * each // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _bit_places(keys, len(packed) * 8)
    look = lambda at: (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (look(a) & look(b)).astype(bool)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for b in byte_slices(batches):
        found = []
        for text in b.column(0).to_pylist():
            words = words_of(text)
            if len(words) >= WINDOW:
                found.append(window_anchors(np.fromiter(map(ids.__getitem__, words), _U64, len(words)))[1])
        if found:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["anchor", "n"])


_PLACE = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())])
_SEGMENT = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("words", pa.binary()), ("n", pa.int64()), ("places", pa.list_(_PLACE))])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _segments(recurring, hot):  # noqa: ANN001, ANN202 - broadcast variables
    def rows(held: dict[tuple[int, bytes], list]) -> Iterator[pa.RecordBatch]:
        every = list(held.items())
        for at in range(0, len(every), 20_000):
            part = every[at : at + 20_000]
            flat = [p for _, v in part for p in v]
            place = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], f.type) for i, f in enumerate(_PLACE)], fields=list(_PLACE))
            offsets = np.concatenate([[0], np.cumsum([len(v) for _, v in part])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([k for (k, _), _ in part], pa.int64()), pa.array([_signed(xxhash.xxh64_intdigest(w)) for (_, w), _ in part], pa.int64()), pa.array([w for (_, w), _ in part], pa.binary()),
                pa.array([sum(p[3] for p in v) for _, v in part], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), place),
            ], schema=_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packed, very = _Ids(), recurring.value, hot.value
        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for b in byte_slices(batches):
            texts: dict[tuple[int, int], list] = {}
            for text in b.column(0).to_pylist():
                texts.setdefault(text_key(text), [text, 0])[1] += 1
            for (k1, k2), (text, times) in texts.items():
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                h = np.fromiter(map(ids.__getitem__, words), _U64, len(words))
                anchor, _ = window_anchors(h)
                first, n_windows = runs_of(anchor)
                keys = anchor[first]
                live = may_hold(packed, keys)
                small = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()
                for f, n, key in zip(first[live].tolist(), n_windows[live].tolist(), keys[live].view(np.int64).tolist(), strict=True):
                    if key in very:
                        cuts = [(None, i, i + WINDOW) for i in range(f, f + n)]
                    else:
                        cuts = [(key, f, f + n + WINDOW - 1)]
                    for shard, lo, hi in cuts:
                        raw = small[WORD * lo : WORD * hi]
                        name = (xxhash.xxh64_intdigest(raw, 3) >> 1 if shard is None else shard, raw)
                        if name not in held:
                            held[name] = []
                            size += len(raw) + 200
                        held[name].append((k1, k2, lo, times))
                        size += 120
                if size > HELD_BYTES:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return run


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, segment, words, n) sorted by shard: spans of words in a segment that confirmed passages cover."""
    width = WORD * WINDOW
    out = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def letters(raw: bytes) -> tuple[int, ...]:
        return tuple(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, WORD)[:, :4]).view("<u4")[:, 0].tolist())

    def stream(segments: list[tuple[int, int, bytes]], passages: set[bytes]) -> Iterator[pa.RecordBatch]:
        if not passages:
            return
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in passages:
            machine.add_word(letters(p), len(p) // WORD)
        machine.make_automaton()
        rows = []
        for shard, segment, raw in segments:
            spans: list[list[int]] = []
            for last, n in machine.iter(letters(raw)):
                a, b = last - n + 1, last + 1
                if raw[WORD * a : WORD * b] not in passages:  # equal in 32 bits of each word only
                    continue
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, b])
            if spans:
                rows.append({"shard": shard, "segment": segment, "spans": [{"a": a, "b": b} for a, b in spans]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    def confirmed(group: dict[bytes, list[int]]) -> set[bytes]:
        """Runs of windows that have two or more places."""
        counts: dict[bytes, int] = {}
        for raw, (_, times) in group.items():
            for i in range(0, len(raw) - width + 1, WORD):
                w = raw[i : i + width]
                counts[w] = counts.get(w, 0) + times
        found = set()
        for raw in group:
            start = None
            for i in range(0, len(raw) - width + WORD + 1, WORD):
                again = i <= len(raw) - width and counts[raw[i : i + width]] > 1
                if again and start is None:
                    start = i
                elif not again and start is not None:
                    found.add(raw[start : i - WORD + width])
                    start = None
        return found

    group: dict[bytes, list[int]] = {}  # distinct segments of one shard: their number and count
    shard = None
    segments: list[tuple[int, int, bytes]] = []
    passages: set[bytes] = set()
    n_words = 0

    def close() -> None:
        nonlocal n_words
        if len(group) > 1 or any(times > 1 or len(raw) > width for raw, (_, times) in group.items()):
            new = confirmed(group)
            if new:
                passages.update(new)
                n_words += sum(map(len, new)) // WORD
                segments.extend((shard, segment, raw) for raw, (segment, _) in group.items())

    for b in batches:
        for key, segment, raw, times in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if key != shard:
                close()
                group, shard = {}, key
                if n_words > MAX_PATTERN_WORDS:
                    yield from stream(segments, passages)
                    segments, passages, n_words = [], set(), 0
            group.setdefault(raw, [segment, 0])[1] += times
    close()
    yield from stream(segments, passages)


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """k1, k2 (hash of a text), spans (start and end of covered words, sorted, may overlap) of texts that repeat windows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_census, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    twice = materialize(counted.filter("n > 1"), "substrings-anchors")
    n, places = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    very = [r["anchor"] for r in twice.filter(F.col("n") > max(HOT, places // 10_000)).select("anchor").collect()]  # at most 10,000
    recurring = spark.sparkContext.broadcast(bit_set(twice.select("anchor"), n))
    hot = spark.sparkContext.broadcast(frozenset(very))
    segments = materialize(
        texts.mapInArrow(_segments(recurring, hot), "shard long, segment long, words binary, n long, places array<struct<k1:long,k2:long,at:int>>"),
        "substrings-segments"
    )
    distinct = segments.select("shard", "segment", "words", "n").repartition("shard").sortWithinPartitions("shard")
    covered = distinct.mapInArrow(_locate, "shard long, segment long, spans array<struct<a:int,b:int>>")
    each = segments.select("shard", "segment", "places").join(covered, ["shard", "segment"]).select("spans", F.explode("places").alias("p"))
    spans = each.select(
        "p.k1", "p.k2",
        F.explode(F.transform("spans", lambda s: F.struct((F.col("p.at") + s["a"]).alias("at"), (F.col("p.at") + s["b"]).alias("end")))).alias("s")
    )
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _joined(words: list[bytes], digest: bool) -> str:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space, or the sha256 of that): one row for each input row.

    A null text has no words. Equal texts repeat each other.
    """
    spans = materialize(repeated_spans(docs, text_col), "substrings-spans")
    n = spans.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    covered = docs.sparkSession.sparkContext.broadcast(bit_set(spans.select("k1"), n))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without spans are done; the others keep their text for the join with theirs."""
        for b in byte_slices(batches):
            texts = b.column(1).to_pylist()
            keys = [text_key(t) for t in texts]
            maybe = may_hold(covered.value, np.array([k for k, _ in keys], np.int64).view(_U64)) if n else np.zeros(len(texts), bool)
            n_words, kept = [], []
            for m, t in zip(maybe, texts, strict=True):  # one text's words at a time: they take many times its size
                words = words_of(t)
                n_words.append(len(words))
                kept.append(None if m else _joined(words, digest))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n_words, pa.int64()), pa.array(kept, pa.string()),
                    pa.array([t or "" if m else None for m, t in zip(maybe, texts, strict=True)], pa.string()), pa.array([k for k, _ in keys], pa.int64()),
                    pa.array([c for _, c in keys], pa.int64())
                ],
                names=["doc_id", "n_words", "kept", "text", "k1", "k2"]
            )

    halves = rows.mapInArrow(split, "doc_id long, n_words long, kept string, text string, k1 long, k2 long")
    return _finish(halves, spans, digest)


def _finish(halves: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    halves = materialize(halves, "substrings-texts")
    done = halves.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    joined = halves.filter("text IS NOT NULL").select("doc_id", "text", "k1", "k2").join(spans, ["k1", "k2"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                out, at = [], 0
                for s in found or []:
                    out += words[at : s["at"]] if s["at"] > at else []
                    at = max(at, s["end"])
                out += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(_joined(out, digest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return done.unionByName(joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """n_words, n_removed and sha256 of the kept words of every text, the plain way (for tests)."""
    lists = [words_of(t) for t in texts]
    counts: dict[tuple, int] = {}
    for w in lists:
        for i in range(len(w) - WINDOW + 1):
            k = tuple(w[i : i + WINDOW])
            counts[k] = counts.get(k, 0) + 1
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if counts[tuple(w[i : i + WINDOW])] > 1:
                gone[i : i + WINDOW] = [True] * WINDOW
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere."""
    got = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return got.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
