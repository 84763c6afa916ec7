"""Language identification by a byte convolutional network, trained in numpy.

A text is lower-cased and its UTF-8 bytes (ASCII that isn't a letter becomes a space) are laid into
windows of WINDOW positions. Filters of several widths slide over the bytes; each window keeps
every filter's maximum, and a softmax layer turns the maxima into language shares. A document's
shares are the means over its windows, weighted by their letters. Since a filter adds one weight for
each byte, its responses are sums of table rows, so inference is gathers from small tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import arrow_map, crc_mod, sampled, table

WINDOW = 256
WIDTHS = (2, 3, 4)
_PAD = max(WIDTHS)
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_WEIGHT = np.array([b >= 97 for b in range(256)], np.float32)


def to_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each padded to whole windows, and the number of windows of each."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    buf = b"".join(t.ljust(int(n) * WINDOW, b" ") for t, n in zip(texts, counts, strict=True)) + b" " * _PAD
    return np.frombuffer(buf, np.uint8), counts


@dataclass
class ByteNet:
    langs: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, F)
    dense: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self._pairs: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._pairs = {}

    def _tables(self, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        if k not in self._pairs:
            w = self.filters[k]
            two = lambda a, b: (w[a][:, None, :] + w[b][None, :, :]).reshape(65536, -1)
            self._pairs[k] = two(0, 1), two(2, 3) if k == 4 else w[2] if k == 3 else None
        return self._pairs[k]

    def maxima(self, buf: np.ndarray) -> np.ndarray:
        """Per window the maximum of each filter; buf ends with _PAD spare bytes."""
        n = (len(buf) - _PAD) // WINDOW
        pair = buf[:-1].astype(np.int32) * 256 + buf[1:]
        parts = []
        for k in WIDTHS:
            first, rest = self._tables(k)
            z = first[pair[: n * WINDOW]]
            if rest is not None:
                z += rest[(pair if k == 4 else buf)[2 : 2 + n * WINDOW]]
            parts.append(z.reshape(n, WINDOW, -1).max(axis=1))
        return np.concatenate(parts, axis=1)

    def shares(self, buf: np.ndarray) -> np.ndarray:
        z = np.maximum(self.maxima(buf), 0) @ self.dense + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raw = [to_bytes(t) for t in texts]
        buf, counts = lay_out(raw)
        weights = _WEIGHT[buf[:-_PAD]].reshape(-1, WINDOW).sum(axis=1) + 1e-3
        step = 256
        got = np.concatenate([self.shares(buf[at * WINDOW : min(len(weights), at + step) * WINDOW + _PAD]) for at in range(0, len(weights), step)]) * weights[:, None]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = np.add.reduceat(got, starts, axis=0) / np.add.reduceat(weights, starts)[:, None]
        best = total.argmax(axis=1)
        lang, score = [], []
        for i, t in enumerate(texts):
            letter = any(c.isalpha() for c in t or "")
            lang.append(self.langs[best[i]] if letter else "und")
            score.append(float(min(1.0, max(0.0, total[i, best[i]]))) if letter else 0.0)
        return lang, score


def fit(texts: list[str], langs: list[str], filters: int = 16, steps: int = 1500, batch: int = 64, seed: int = 7) -> ByteNet:
    """Adam on windows cut at random places and lengths from the texts, languages in equal parts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    raw = [to_bytes(t) for t in texts]
    by = [[i for i, x in enumerate(langs) if x == name and raw[i].strip()] for name in names]
    names, by = [n for n, b in zip(names, by, strict=True) if b], [b for b in by if b]
    net = ByteNet(
        names, {k: rng.normal(0, 0.3 / k**0.5, (k, 256, filters)).astype(np.float32) for k in WIDTHS},
        rng.normal(0, 0.1, (filters * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    )
    params = [*net.filters.values(), net.dense, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        cut = []
        for lang in y:
            t = raw[by[lang][rng.integers(len(by[lang]))]]
            n = min(len(t), int(WINDOW * min(1.0, 1.6 * rng.random() ** 1.5 + 0.04)))
            at = int(rng.integers(0, len(t) - n + 1))
            cut.append(t[at : at + n].ljust(WINDOW + _PAD, b" "))
        x = np.frombuffer(b"".join(cut), np.uint8).reshape(batch, WINDOW + _PAD)
        tops, hidden = [], []
        for k in WIDTHS:
            w = net.filters[k]
            z = sum(w[j][x[:, j : j + WINDOW]] for j in range(k))
            tops.append(z.argmax(axis=1))
            hidden.append(np.take_along_axis(z, tops[-1][:, None, :], 1)[:, 0, :])
        h = np.concatenate(hidden, axis=1)
        a = np.maximum(h, 0)
        s = a @ net.dense + net.bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        dh = (p @ net.dense.T) * (h > 0)
        grads = []
        for i, k in enumerate(WIDTHS):
            g = np.zeros_like(net.filters[k])
            d = dh[:, i * filters : (i + 1) * filters]
            for j in range(k):
                np.add.at(g[j], (x[np.arange(batch)[:, None], tops[i] + j], np.arange(filters)[None, :]), d)
            grads.append(g + 1e-5 * net.filters[k])
        grads += [a.T @ p + 1e-4 * net.dense, p.sum(axis=0)]
        for q, g, mm, vv in zip(params, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q -= (0.01 * (1 - step / (steps + 1)) + 1e-4) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, per_lang: int = 400, cuts: int = 4) -> ByteNet | None:
    """Learns from about per_lang texts of each language at most, chosen by hash: of each, cuts pieces of 512 characters from anywhere in it.

    Only rows with a language and crc32(doc_id) mod 3 other than 1 count; equal rows count once. None:
    nothing to learn from.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_mod("doc_id", 3) != 1))
    counts = {r["lang"]: r["count"] for r in rows.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])[F.col("lang")]
    room = F.greatest(F.length("text") - 2 * WINDOW, F.lit(1))
    pieces = F.array(*[F.substr("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1, F.lit(2 * WINDOW)) for i in range(cuts)])
    got = rows.filter(sampled(F.xxhash64("doc_id", "text"), share)).select("lang", pieces.alias("pieces")).distinct().collect()  # per_lang rows a language on average
    pairs = sorted({(r["lang"], p) for r in got for p in r["pieces"] if p})
    return fit([p for _, p in pairs], [x for x, _ in pairs])


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; `und` and 0 if null, without a letter, or nothing was learned."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(c: dict[str, list]) -> dict[str, list]:
        lang, score = ([], [])
        at, n = 0, len(c["text"])
        while at < n:  # in groups of about 2 MB
            to, size = at, 0
            while to < n and size < 2_000_000:
                size += len(c["text"][to] or "")
                to += 1
            a, b = net.predict(c["text"][at:to]) if net and net.langs else (["und"] * (to - at), [0.0] * (to - at))
            lang += a
            score += b
            at = to
        return {"doc_id": c["doc_id"], "lang_pred": lang, "score": score}

    return rows.mapInArrow(arrow_map(run, out), "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
