"""Decontamination, near-duplicates, repeated passages, mixing and fingerprints."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from packetloom.llm import decontam, iblt, mixing, simhash, substrings


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(n))


# --- SimHash


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_classes(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash_rows(docs_of, odd_texts, as_dict):
    base = prose(1, 300)
    texts = [*odd_texts, base, base + " extra", base.upper(), prose(2, 300), "A\x0bb c\x0cd", "a b c d", "a b c d", "a b c"]
    got = as_dict(simhash.simhash_classes(docs_of(texts)))
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == slow_classes(fps)
    kept = simhash.near_dedup(docs_of(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(slow_classes(fps)))


def test_simhash_null_and_repeated_ids(docs_of):
    rows = [(None, "p q r s t", "en", "s"), (None, "p q r s t", "en", "s"), (7, "k l m n o", "en", "s"), (7, "k l m n o", "en", "s"), (7, "u v w x y z", "en", "s")]
    got = simhash.near_dedup(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == [(-1, "p q r s t"), (7, "k l m n o"), (7, "u v w x y z")]
    assert simhash.simhash_classes(docs_of(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_in_tiles(spark, monkeypatch, tile):
    """Chains and dense groups of fingerprints, also with tiles split by population count."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    for seed in list(fps)[:6]:
        at = seed
        for _ in range(12):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.add(at)
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long"), len(rows), 4)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    ours = {}
    for (f,) in rows:
        ours.setdefault(found.get(f, f), set()).add(f)
    slow = {}
    for (f,), c in zip(rows, slow_classes(fps), strict=True):
        slow.setdefault(c, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, slow.values()))


def test_tiles_are_skipped_by_population_count(monkeypatch):
    """Tile pairs whose counts lie beyond the radius are never compared, and no link is lost."""
    monkeypatch.setattr(simhash, "STEP", 8)
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(20)], np.uint64) for k in range(2, 60, 4)]))
    fps = np.unique(np.concatenate([fps, fps[::3] ^ np.uint64(5)]))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4}
    x, y, compared = simhash.tile_links(fps, None, 4)
    group = {int(f): int(f) for f in fps}
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        group[a] = group[b] if b in group else b
    assert all(group[a] == group[b] for a, b in want) and want
    tiles = -(-len(fps) // 8)
    assert compared < tiles * (tiles + 1) / 2 / 3
    x, y, _ = simhash.tile_links(fps[::2], fps[1::2], 4)
    assert len(x) > 0


def test_components_raise_when_not_settled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        simhash.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))


@pytest.mark.parametrize("n", [100, 1 << 23, 1 << 31])
def test_masks_cover_the_radius(n):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(n, 4)]
    rng = random.Random(2)
    for _ in range(500):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & m == 0 for m in masks)


# --- decontamination


def slow_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for k in range(len(iw) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("set_bytes", "stride"), [(32 << 20, 256), (2000, 3)])
def test_decontamination(spark, docs_of, odd_texts, as_dict, monkeypatch, set_bytes, stride):
    """Also with the set in several shards, and stretches shorter than a window."""
    monkeypatch.setattr(decontam, "SET_BYTES", set_bytes)
    monkeypatch.setattr(decontam, "STRIDE", stride)
    item = prose(9, 25)
    items = [(1, item), (2, "Short item"), (10, None), (3, ""), (4, item), (5, "a b c d e f g h i j k"), (6, "ünïcode")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    texts = [
        *odd_texts, prose(3, 50) + " " + item.upper() + ". " + prose(4, 30), " ".join(item.split()[3:13]), " ".join(item.split()[3:12]),
        "short, ITEM short item", "a b c d e f g h i j k l a b c d e f g h i j", "ÜNÏCODE ünïcode"
    ]
    got = as_dict(decontam.hits(docs_of(texts), bench))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == slow_hits(t, items), t[:30] if t else t
    clean = decontam.remove_contaminated(docs_of(texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(texts) if not slow_hits(t, items)[1]]
    assert decontam.hits(docs_of(texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.hits(docs_of(texts).limit(0), bench).count() == 0
    cut = as_dict(decontam.cut_spans(docs_of(texts), bench))
    for i, t in enumerate(texts):
        assert len(slow_hits(cut[i]["text"], [])) == 3 and slow_hits(cut[i]["text"], [])[0] == slow_hits(t, items)[0] - slow_hits(t, items)[1]
    assert decontam.cut_spans(docs_of(texts), bench).columns == docs_of(texts).columns


def test_cut_spans_keeps_the_rest(spark, docs_of, as_dict):
    bench = spark.createDataFrame([(1, "Alpha beta")], "item_id long, text string")
    texts = ["- One, alpha BETA; two!", "alpha beta", "x alpha  beta", "alpha beta alpha beta\ny", None]
    got = as_dict(decontam.cut_spans(docs_of(texts), bench))
    assert [got[i]["text"] for i in range(5)] == ["- One; two!", "", "x", "\ny", None]


def test_decontamination_of_a_million_windows(spark, docs_of):
    """Far more windows than one scan broadcasts."""
    bench = spark.range(1000).selectExpr("id AS item_id", "array_join(transform(sequence(1, 1009), i -> concat('w', id * 10000 + i)), ' ') AS text")
    inside = [" ".join(f"w{k * 10000 + i}" for i in range(500, 512)) for k in range(0, 1000, 50)]
    docs = docs_of([*inside, *[t.replace("w", "v") for t in inside], "w1 w2 w3 w4 w5 w6 w7 w8 w9 x w11"])
    got = decontam.hits(docs, bench).filter("n_hit > 0").collect()
    assert sorted((r["doc_id"], r["n_hit"], r["items"][0]) for r in got) == [(i, 12, str(k)) for i, k in enumerate(range(0, 1000, 50))]


# --- repeated passages


def test_substrings(docs_of, odd_texts, as_dict):
    a, b, c = prose(11, 200), prose(12, 300), prose(13, 40)
    aw = a.split()
    texts = [
        *odd_texts, a, a + " tail", b + " " + " ".join(aw[50:85]), " ".join(aw[50:84]), c, c, prose(14, 20) + " " + " ".join(aw[20:120]) + " " + prose(15, 20), "p q r s t " * 8, "k " * 36, "k " * 35,
        " ".join(aw[:34]) + " X", "\x0b".join(aw[100:140]),
    ]
    got = as_dict(substrings.remove_repeats(docs_of(texts)))
    want = substrings.brute_force(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want[i], (i, t[:40] if t else t)
    assert substrings.remove_repeats(docs_of(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1_000, 1])
def test_substrings_random(docs_of, as_dict, monkeypatch, hot):
    """Pieces of a few passages in random order, also with every anchor dealt by window."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(7)
    pool = [prose(100 + i, 90).split() for i in range(6)]
    texts = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            at = rng.randrange(60)
            words += p[at : at + rng.randrange(20, 70)] + prose(rng.random(), rng.randrange(0, 4)).split()
        texts.append(" ".join(words))
    got = as_dict(substrings.remove_repeats(docs_of(texts), digest=True))
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(80)] == substrings.brute_force(texts)


# --- mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.water_fill([1000, 10, 10], [1, 2, 3]) == pytest.approx([960, 30, 30])
    assert mixing.water_fill([0, 0], [1, 2]) == [0, 0] and mixing.water_fill([], []) == []
    assert sum(mixing.water_fill([5, 500, 7, 80, 1], [1, 2, 3, 1, 2])) == pytest.approx(593)


def test_mixing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = random.Random(3)
    rows = [(i, prose(i, int(rng.paretovariate(1.2) * 5)), "en", rng.choice(["b", "a", "a", "a", "é", None])) for i in range(1500)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", None), (None, "x y", "en", "a"), (7, "x y", "en", "a"), (7, "x y", "en", "a")]
    docs = docs_of(rows)
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(mixing.copies(docs).columns)
    by = {}
    for r in got:
        assert 0 <= r["_copies"] <= 3 and r["_size"] == len((r["text"] or "").split())
        s = by.setdefault(r["source"], [r["_target"], 0, 0])
        s[1] += r["_copies"] * r["_size"]
        s[2] = max(s[2], r["_size"])
    for target, taken, most in by.values():
        assert abs(taken - target) <= max(most / 2 + 1, 0.02 * target)
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(r["_size"] for r in got))
    again = mixing.copies(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["_size"], r["_copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs).count() == sum(r["_copies"] for r in got)
    assert mixing.copies(docs.limit(0)).count() == 0


def spark_hash(*parts):
    """Spark's xxhash64 of longs and strings, each seeded by the hash before it."""
    h = 42
    for p in parts:
        h = h if p is None else xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def slow_copies(rows):
    """Pivotal rounding the plain way: (id, text) -> copies."""
    size = [len((t or "").split()) for _, t, _, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = [sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names]
    target = mixing.water_fill(total, [1 + i % 3 for i in range(len(names))])
    out, open_ = {}, {}
    for (i, t, _, s), n in zip(rows, size, strict=True):
        k = names.index(s)
        rate = min(3.0, target[k] / total[k]) if total[k] else 0.0
        whole = math.floor(rate + 1e-12)
        salts = -(-sum(r[3] == s for r in rows) // mixing.GROUP)
        key, text = spark_hash(str(i), n, spark_hash(t)), (i, t)
        out[text] = whole
        open_.setdefault((k, spark_hash(str(i), "salt") % salts), []).append([-n, key, n, max(0.0, rate - whole), text])
    most = max(-(-sum(r[3] == s for r in rows) // mixing.GROUP) for s in names)
    while True:
        left = {}
        for (k, salt), group in open_.items():
            held = None
            for x in sorted(group, key=lambda x: x[:2]):
                if x[2] == 0 or x[3] <= 1e-12 or x[3] >= 1 - 1e-12:
                    out[x[4]] += int(x[2] > 0 and x[3] > 0.5)
                    continue
                if held is None:
                    held = x
                    continue
                up, down = min((1 - held[3]) * held[2], x[3] * x[2]), min(held[3] * held[2], (1 - x[3]) * x[2])
                move = up if xxhash.xxh64_intdigest(f"{held[1]}:{x[1]}", 11) / 2**64 * (up + down) < down else -down
                held[3], x[3] = held[3] + move / held[2], x[3] - move / x[2]
                pair = [held, x]
                for y in pair:
                    if y[3] <= 1e-9 or y[3] >= 1 - 1e-9:
                        out[y[4]] += int(y[3] > 0.5)
                held = next((y for y in pair if 1e-9 < y[3] < 1 - 1e-9), None)
            if held is not None:
                if most == 1:
                    out[held[4]] += int(held[3] >= 0.5)
                else:
                    left.setdefault((k, salt // mixing.FAN_IN), []).append(held)
        if most == 1:
            return out
        open_, most = left, -(-most // mixing.FAN_IN)


def test_mixing_is_pivotal_rounding(docs_of, monkeypatch):
    """Row by row the same as the plain way, over several levels of the tree."""
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randrange(0, 60)) or None, "en", rng.choice(["b", "a", "a", "c", "é", None])) for i in range(400)]
    rows = [(i, t if t else None, lang, s) for i, t, lang, s in rows] + [(900 + i, "w " * 5, "en", "tiny") for i in range(3)]
    got = {(r["doc_id"], r["text"]): r["_copies"] for r in mixing.copies(docs_of(rows)).collect()}
    assert got == slow_copies(rows)


@pytest.mark.parametrize("sizes", [[5, 500, 7, 80, 1], [1000, 10, 10], [0, 0, 3], [0], list(range(1, 40))])
def test_targets_in_spark(spark, sizes):
    """Ranks and targets as water_fill gives them; null comes last."""
    names = [*[f"s{i:03}" for i in range(len(sizes) - 1)], None]
    rows = spark.createDataFrame([(n, k) for n, k in zip(names, sizes, strict=True) for _ in range(2)], "source string, size long")
    got = sorted(mixing.targets(rows).collect(), key=lambda r: r["source_no"])
    assert [r["source"] for r in got] == names and [r["source_no"] for r in got] == list(range(len(names)))
    assert [r["target"] for r in got] == pytest.approx(mixing.water_fill([2 * k for k in sizes], [1 + i % 3 for i in range(len(sizes))]))


# --- fingerprints


def by_content(piece):
    """Plain re-implementation of the breaks in long pieces."""
    ends = lambda x: xxhash.xxh64_intdigest(x.encode(), 42) % iblt.EVERY == 0
    out = ""
    for w in piece.split(" "):
        if len(w) > iblt.LONG:
            out += "".join(c + "\n" * ends(w[max(0, i - 1) : i + 1]) for i, c in enumerate(w)) + " "
        else:
            out += w + ("\n" if ends(w) else " ")
    return out.split("\n")


def whole_pieces(t):
    cut = re.split(r"\n|(?<=[.!?]) |(?<=[。！？])", t)
    return {p for c in cut for p in (by_content(c) if len(c) > iblt.LONG else [c]) if p}


def test_fingerprints(docs_of, odd_texts):
    long = "\n".join(prose(i, 5) for i in range(600))
    texts = [*odd_texts, long, long + "\nmore", "a. b. c. d.\ne", "a. b. c. d.\ne", "one. two! three? four", "\U0001f600" * 10]
    rows = {r["doc_id"]: r for r in iblt.fingerprint_versions(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i in rows:
        t, nxt = texts[i] or "", texts[i - 1 if i else len(texts) - 1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        r, of = rows[i], whole_pieces
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(of(t), of(edited))) and r["near_next"] == pytest.approx(like(of(t), of(nxt)))
    assert len({rows[i]["fingerprint"] for i, t in enumerate(texts)}) == len({frozenset(whole_pieces(t or "")) for t in texts})


def test_peeling_retries_larger(docs_of, monkeypatch):
    """Tables too small for their groups are retried larger; where all get stuck, the likeness is null."""
    texts = ["\n".join(prose(i, 3) for i in range(k, k + 60)) for k in (0, 20, 100)]
    want = {0: 0.0, 1: 40 / 80, 2: 0.0}
    monkeypatch.setattr(iblt, "LEVELS", (6, 12, 96))
    got = {r["doc_id"]: r["near_next"] for r in iblt.fingerprint_versions(docs_of(texts)).collect()}
    assert got == pytest.approx(want)
    monkeypatch.setattr(iblt, "LEVELS", (3,))
    assert iblt.fingerprint_versions(docs_of(texts)).filter("doc_id = 0").first()["near_next"] is None


def test_fingerprint_ranges(docs_of):
    """Neighbours over many ranges, with null and repeated ids."""
    rows = [(i * 7 % 50, f"text {i}.", "en", "s") for i in range(50)] + [(None, "null", "en", "s"), (3, "again", "en", "s")]
    got = iblt.with_next(docs_of(rows), 150).collect()
    assert len(got) == 52 and sorted(r["text"] for r in got) == sorted(r["next_text"] for r in got)
    ids = {r["text"]: r["doc_id"] for r in got}
    for r in got:
        if r["doc_id"] not in (None, 0):
            assert ids[r["next_text"]] in (r["doc_id"], r["doc_id"] - 1)
    assert ids[next(r for r in got if r["text"] == "null")["next_text"]] == 49
    hot = [(x, f"{x} {i}", "en", "s") for x in (None, 9, 4, 30) for i in range(300 if x in (None, 9) else 2)]
    got = {r["text"]: r["next_text"] for r in iblt.with_next(docs_of(hot), 500).collect()}
    assert len(got) == 604 == len(set(got.values())) and iblt._ranged(docs_of(hot).select("doc_id", "text"), 500).select("bucket").distinct().count() > 100
    at, seen = next(t for t, n in got.items() if n.startswith("30") and t.startswith("None")), []
    for _ in range(604):
        at = got[at]
        seen.append(at.split()[0])
    assert seen == ["30"] * 2 + ["9"] * 300 + ["4"] * 2 + ["None"] * 300
    one = iblt.with_next(docs_of(["only"])).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("only", "only")] and iblt.with_next(docs_of(["a"]).limit(0)).count() == 0


def test_fingerprint_pieces(docs_of):
    """Every sentence end cuts, whatever stands before it, and long pieces are cut by content."""
    rng = random.Random(4)
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    texts = [
        " ".join(f"{prose(i, 6)} {e}" for i, e in enumerate(("cat.", "NASA!", "in 1999.", "café?", "мир.", "end.") * 5)), "一つ。二つ！三つ？" * 2 + "四つ。五つ", prose(31, 900), han, "a" * 900 + " b", "Short one. Cat sat. X",
        "word " * 2000, "x" * 1000 + " y" * 400,
    ]
    rows = {r["doc_id"]: r for r in iblt.fingerprint_versions(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        nxt = texts[i - 1 if i else len(texts) - 1]
        k = len(t) // 3
        a, b, c = whole_pieces(t), whole_pieces(t[: len(t) - k] + nxt[:k]), whole_pieces(nxt)
        assert int(rows[i]["fingerprint"].split(":")[0]) == len(a)
        assert rows[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and rows[i]["near_next"] == pytest.approx(len(a & c) / len(a | c))
    assert all(rows[i]["near_edited"] > 0.2 for i in (0, 1, 2, 3))
