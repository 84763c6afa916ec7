"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon (a few fixed words and word stems learned from labelled
texts), closeness of its words to second-person pronouns, capitals, punctuation and obfuscation.
Lexicon, trees and calibration are learned from a bounded, hash-chosen sample of labelled rows
(``max_rows``); every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm._common import arrow_map, byte_slices, crc_mod, free_name, sampled, table

#: Insults that count before anything is learned (fixed values).
SEED = frozenset(
    "idiot idiots moron morons loser losers stupid scum trash pathetic worthless disgusting clown dumb fool jerk retard bastard bitch asshole shit fuck fucking dummkopf arschloch abschaum connard imbécile salaud idiota imbécil estúpido basura".split()
)
#: Pronouns of the second person (fixed values).
PRONOUNS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos usted ustedes tus vosotros".split())
FEATURES = ("seed", "learned", "learned_log", "hidden", "person", "near", "capitals", "shout", "exclaim", "punct", "odd", "repeat", "digits", "log_words", "length")

_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\W\d_]+[0-9@$!*.\-]{1,2}[^\W\d_]")
_HIDDEN = re.compile(r"\w(?:[\w@$!*.\-]*\w)?")
_UPPER = bytes(range(65, 91))
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$!", "oieastasi", "*.-_")


def stems_of(word: str) -> Iterator[str]:
    """The word (with an end mark) and its prefixes of 4 to 6 letters."""
    yield word + "$"
    for k in (4, 5, 6):
        if len(word) >= k:
            yield word[:k]


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    """The values of FEATURES; all zero for a text without words."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    distinct = set(words)
    seeds = distinct & SEED
    learned = {w for w in distinct if w[:4] in lexicon or w[:5] in lexicon or w[:6] in lexicon or w + "$" in lexicon}
    people = distinct & PRONOUNS
    odd = _ODD.findall(lower) if re.search(r"[a-z][0-9@$!*.\-]{1,2}[a-z]", lower) else []
    hidden = 0
    if odd:
        for w in set(_HIDDEN.findall(lower)):
            plain = w.translate(_LEET)
            if plain != w and plain.isalpha() and (plain in SEED or any(s in lexicon for s in stems_of(plain))):
                hidden += 1
    bad = seeds | learned
    hits = {w: 0 for w in bad}
    near = 0.0
    if bad:
        last_bad = last_you = None
        best = n
        for i, w in enumerate(words):
            if w in hits:
                hits[w] += 1
                last_bad = i
                if last_you is not None:
                    best = min(best, i - last_you)
            if w in people:
                last_you = i
                if last_bad is not None:
                    best = min(best, i - last_bad)
        near = 1 / (1 + best) if last_you is not None else 0.0
    n_learned, chars = sum(hits[w] for w in learned), len(text)
    raw = text.encode("utf-8", "replace")
    upper = (len(raw) - len(raw.translate(None, _UPPER))) / chars
    return [
        sum(hits[w] for w in seeds) / n, n_learned / n, math.log1p(n_learned), hidden / n,
        len(people) / len(distinct), near, upper, float(upper > 0.5), text.count("!") / chars,
        1 - sum(map(len, words)) / chars - (text.count(" ") + text.count("\n")) / chars, len(odd) / n,
        len(_REPEAT.findall(lower)) / n, (len(raw) - len(raw.translate(None, b"0123456789"))) / chars, math.log1p(n), chars / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, on quantile bins; each is a flat array of nodes."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        cuts = [np.unique(np.append(q, [v for v in (0.0,) if (c > 0).any()])) for q, c in zip(cuts, x.T, strict=True)]
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feat, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), int)
            for at in range(size):
                mine = np.flatnonzero(node == at)
                if not len(mine):
                    continue
                g, h = grad[mine], hess[mine]
                value[at] = g.sum() / (h.sum() + 1.0)
                if at >= 2**self.depth - 1 or len(mine) < 8:
                    continue
                best = (1e-4, -1, 0.0)
                for k, q in enumerate(cuts):
                    if len(q):
                        b = np.searchsorted(q, x[mine, k], side="left")  # bin i holds values at most q[i]
                        gl, hl = (np.cumsum(np.bincount(b, w, len(q) + 1))[:-1] for w in (g, h))
                        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), k, float(q[i]))
                if best[1] >= 0:
                    feat[at], cut[at] = best[1:]
                    node[mine] = 2 * at + np.where(x[mine, best[1]] <= best[2], 1, 2)
            self.trees.append((feat, cut, value * self.rate))
            score += self._leaf(x, *self.trees[-1])
        return self

    @staticmethod
    def _leaf(x: np.ndarray, feat: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(int(math.log2(len(feat) + 1)) - 1):
            f = feat[node]
            node = np.where(f < 0, node, 2 * node + np.where(x[rows, np.maximum(f, 0)] <= cut[node], 1, 2))
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._leaf(x, *t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and values, smoothed by half a row of either label at each end. Equal scores are pooled first."""
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for s, ones, n in zip(values.tolist(), np.bincount(inverse, y, len(values)).tolist(), counts.tolist(), strict=True):
        blocks.append([ones, float(n), s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = [v for b in blocks for v in b[2:4]]
    ys = [v for b in blocks for v in [(b[0] + 0.25) / (b[1] + 0.5)] * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        raw = self.trees.predict(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES)))
        p = 1 / (1 + np.exp(-raw))
        if self.knots is not None:  # a little of the raw score keeps the order within a block
            p = 0.98 * np.interp(raw, *self.knots) + 0.02 * p
        return np.clip(p, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from rows of labels (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0; at most about max_rows, chosen by hash.

    Rows with a null label are left out; of several labels of one id the greatest counts, of several
    texts the least. Without both labels, all scores are the share of label 1.
    """
    marked = labels.select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")
    ).filter(F.col("toxic").isin(0, 1) & (crc_mod("_id", 5) != 0)).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel(frozenset(), None, None, float(counts.get(1, 0) > 0))
    share = {1: min(1.0, max_rows // 3 / counts[1]), 0: min(1.0, (max_rows - max_rows // 3) / counts[0])}
    chosen = marked.filter(sampled(F.col("_id"), F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # chosen holds max_rows ids on average, by the shares
    texts = texts.groupBy("_id", "toxic").agg(F.min("text").alias("text"))

    fold = crc_mod("_id", 5)
    rows = texts.select("text", "toxic", fold.alias("fold"))

    def stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        n = [0, 0]
        for b in byte_slices(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                for s in {s for w in set(_WORD.findall((text or "").lower())) for s in stems_of(w)}:
                    seen.setdefault(s, [0, 0])[toxic] += 1
        seen[""] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["stem", "n0", "n1"]
        )

    learn = rows.filter("fold < 3").select("text", "toxic")
    counted = learn.mapInArrow(stem_counts, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    strong = counted.filter((F.col("stem") == "") | (F.col("n1") >= 3) & (F.col("n1") > 4 * F.col("n0")))
    got = {r["stem"]: (r["n0"], r["n1"]) for r in strong.collect()}  # stems of a bounded sample
    n0, n1 = got.pop("", (0, 0))
    share = n1 / max(1, n0 + n1)

    def evidence(a0: int, a1: int) -> float:
        return 2 * sum(o * math.log(o / e) for o, e in ((a1, (a0 + a1) * share), (a0, (a0 + a1) * (1 - share))) if o)

    # the rate among the toxic must stand far above that among the others
    lexicon = frozenset(s for s, (a0, a1) in got.items() if share < 1 and evidence(a0, a1) >= 15 and a1 / n1 > 8 * (a0 + 0.5) / max(1, n0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            x = [features(t, lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "toxic", "fold"])

    table_ = rows.select("text", "toxic", F.col("fold").cast("int").alias("fold")).mapInArrow(measure, "x array<double>, toxic int, fold int").toArrow()
    x = np.array(table_["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y, f = np.array(table_["toxic"].to_pylist(), dtype=float), np.array(table_["fold"].to_pylist(), dtype=int)
    order = np.lexsort((*x.T, y, f))  # the same model whatever the order of the rows
    x, y, f = x[order], y[order], f[order]
    fit = f != 4
    if len({*y[fit]}) < 2:
        return ToxicityModel(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    trees = Trees().fit(x[fit], y[fit])
    knots = isotonic(trees.predict(x[~fit]), y[~fit]) if (~fit).sum() >= 50 and len({*y[~fit]}) == 2 else None
    return ToxicityModel(lexicon, trees, knots, float(y.mean()))


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """docs and, as the last column, the score of every whole text (null: empty), 0 to 1.

    One row for each input row, repeats included. The score's name is score_col, by default
    _toxicity with as many underscores after it as docs' own names demand.
    """
    at = docs.columns.index(text_col)
    score_col = score_col or free_name(docs, "_toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column(at).to_pylist()), pa.float64())], names=[*map(str, range(b.num_columns)), "score"])

    # columns are handed on by place, so that names of the input can't clash
    named = docs.toDF(*map(str, range(len(docs.columns))))
    out = named.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.toDF(*docs.columns, score_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score the threshold or more.

    Null and empty texts score as texts without words do. Repeated rows stay or go together. An empty
    table, or labels without both classes, drops nothing unless all labels are 1.
    """
    score = free_name(docs, "_toxicity")
    return with_score(docs, train(docs, labels), score_col=score).filter(F.col(score) < threshold).drop(score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    scored = rows.mapInArrow(arrow_map(lambda c: {"doc_id": c["doc_id"], "score": model.scores(c["text"])}, out), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
