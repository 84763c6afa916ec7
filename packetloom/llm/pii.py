"""Personal data in text, disguised or plain, with spans in the source's code points.

Plain identifiers are found by fixed patterns. Disguised ones are found by transducers: each
rewrites some source characters (look-alike letters and digits, zero-width characters, spelled
digits, `[at]`/`(dot)` and the like) and keeps, for every character that it puts out, the source
span it stands for. The same patterns run over the rewritten text, and what they find is mapped back
to source spans. Disguised spans are added where they overlap no plain span of their kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm._common import arrow_map, byte_slices, table

KINDS = ("email", "ip", "card", "phone")

# Patterns are written so that no start is tried twice: time is linear in the text.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9]++)++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

#: Letters and digits of other scripts that look like ASCII ones (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝвкмнтАВЕКМНОРСТХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbkmhtABEKMHOPCTXIJSaoivptukABEZHIKMNOPTYX", strict=True))
#: Characters that show nothing (fixed values).
INVISIBLE = frozenset("​‌‍⁠﻿­")
#: Digit words of English, German, French and Spanish (fixed values).
DIGIT_WORDS = {
    w: str(i)
    for i, words in enumerate(("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in words.split()
}

_STRANGE = re.compile("[" + "".join(HOMOGLYPHS) + "".join(INVISIBLE) + "！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
_WORDY = "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True))
# a run of spelled digits, perhaps with plain ones between, of four at least
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:{_WORDY}|[0-9]+)(?:[ \-,.]{{1,2}}(?:{_WORDY}|[0-9]+)){{3,}}(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"plus[ -]+|{_WORDY}|[0-9]+|[ \-,.]+", re.I)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?", re.I)
_BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]\s?", re.I)
# bare words count only as a whole address: name at host dot ending
_BARE = re.compile(
    r"(?<![\w.%+-])(?<![\w%+-] dot )([A-Za-z0-9_%+-]++(?:(?: dot |\.)[A-Za-z0-9_%+-]++)*+)( at |@)([A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]{2,}+)++)(?![\w-])",
    re.I
)
_BARE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: dot |\.)[0-9]{1,3}){3}(?![\w])", re.I)
_BARE_DOT = re.compile(r" dot ", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost, non-overlapping spans of each kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = at = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out["email"].append((start, m.end()))
                done = m.end()
    if _DIGITS.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out["phone"].append(m.span())
    return out


class Mapped:
    """Rewritten text with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans (in order, apart from each other); each new character stands for the whole span."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [*self.start[at:a]] + [self.start[a]] * len(new)
            ends += [*self.end[at:a]] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(parts) + self.text[at:]
        self.start, self.end = [*starts, *self.start[at:]], [*ends, *self.end[at:]]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _STRANGE.finditer(text):
        c = m.group()
        new = "" if c in INVISIBLE else HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
        if c.isdigit() and not new.isascii():
            new = str(unicodedata.digit(c))
        if new.isascii():
            out.append((m.start(), m.end(), new))
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(m.group()))
        if sum(p.group().lower() in DIGIT_WORDS for p in parts) < 2:
            continue
        for p in parts:
            w = p.group().lower()
            new = "+" if w.startswith("plus") else DIGIT_WORDS.get(w, w if w.isdigit() else "")
            if new != p.group():
                out.append((m.start() + p.start(), m.start() + p.end(), new))
    return out


def _dots(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)]
    return sorted(edits)


def _bare(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BARE.finditer(text):
        if " dot " not in m.group(3).lower() and m.group(2) != "@":
            continue  # "look at this.example" is prose
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _BARE_DOT.finditer(m.group())]
        edits.append((*m.span(2), "@"))
    for m in _BARE_IP.finditer(text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _BARE_DOT.finditer(m.group())]
    return sorted(set(edits))


def disguised_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans that the patterns find in the rewritten text, in the source's code points."""
    low = text.lower()
    steps = [_look_alikes] if not text.isascii() and _STRANGE.search(text) else []
    if steps or _SPELLED.search(text):
        steps.append(_spelled)
    if steps or any(c in text for c in "[({<"):
        steps.append(_dots)
    if steps or " dot " in low:
        steps.append(_bare)
    mapped, changed = Mapped(text) if steps else None, False
    for step in steps:
        if edits := step(mapped.text):
            mapped.rewrite(edits)
            changed = True
    if not changed:
        return {}
    return {k: [mapped.source(a, b) for a, b in v] for k, v in plain_spans(mapped.text).items()}


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans, by kind; none for null."""
    text = text or ""
    base = plain_spans(text)
    more = disguised_spans(text)
    every = {}
    for k in KINDS:
        every[k] = list(base[k])
        taken = sorted(base[k])
        for a, b in more.get(k, []):
            if not any(a < y and x < b for x, y in taken):
                every[k].append((a, b))
        every[k].sort()
    return base, every


def digest(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans of several kinds become one."""
    if text is None:
        return None
    _, every = find(text)
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, v in every.items() for a, b in v):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of plain spans by kind, sha256 of the plain spans, all spans, and their number.

    One row for each input row, in no order; a null text is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def run(c: dict[str, list]) -> dict[str, list]:
        found = [find(t) for t in c["text"]]
        counts = {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
        return {
            "doc_id": c["doc_id"], **counts, "base_sha256": [hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in found],
            "spans": [digest(e) for _, e in found], "n_spans": [sum(map(len, e.values())) for _, e in found]
        }

    return rows.mapInArrow(arrow_map(run, out), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced in text_col, and length_col (if there is one) set to the new length.

    One row for each input row, repeats included, in docs' columns. A null text stays null and its
    length becomes null; an empty one stays empty; an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    named = docs.toDF(*map(str, range(len(docs.columns))))

    def run(batches):  # noqa: ANN001, ANN202
        for b in byte_slices(batches):
            cols = list(b.columns)
            cols[at] = pa.array([redact_text(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names))

    fields = [T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(named.schema.fields)]
    out = named.mapInArrow(run, T.StructType(fields)).toDF(*docs.columns)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return detect(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of plain identifiers of every document."""
    return op1_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])


BASE_ORACLE = r"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
    [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+')] AS card, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]')] AS phone
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len([x FOR x IN ip IF list_max([coalesce(try_cast(p AS HUGEINT), 999) FOR p IN string_split(x, '.')]) <= 255]) AS BIGINT) AS n_ip,
  CAST(len([x FOR x IN card IF len(x) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CAST(reverse(x)[i + 1] AS INTEGER) ELSE CAST(reverse(x)[i + 1] AS INTEGER) * 2 - CASE WHEN reverse(x)[i + 1] > '4' THEN 9 ELSE 0 END END FOR i IN range(len(x))]) % 10 = 0]) AS BIGINT) AS n_card,
  CAST(len([x FOR x IN phone IF len(x) BETWEEN 9 AND 15]) AS BIGINT) AS n_phone FROM m
"""
