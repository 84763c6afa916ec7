"""License scans with DataFrame functions only.

Base phrases are counted over whole texts. The scan proper runs ordered signature rules over the
words of a text, across line ends: regexes in three ranks (exact names and identifiers, names with a
version, mere families), made from families, versions and phrasings. Rules run over stretches of
CORE words with REACH words (more than any rule spans) on each side; a match counts in the stretch in
which it begins. A document is looked at only if it holds a word of the gate, which every match
of every rule holds, a stretch only if it holds one, and a rule only if the stretch holds the rule's own
keyword. A match inside the span of a match of better rank, or inside a longer one of its own rank,
is suppressed.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import ascii_lower, table

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a stretch, and words on each side of it that the rules also see (no rule spans more).
CORE = 128
REACH = 40
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
CONFIDENCE = (0.98, 0.85, 0.6)


def _rules_of(rank: int, keyword: str, labels_patterns) -> list[tuple[int, str, str, str]]:  # noqa: ANN001
    return [(rank, keyword, label, pattern) for label, pattern in labels_patterns]


@cache
def rules() -> tuple[tuple[int, str, str, str], ...]:
    """(rank, keyword, label, regex) in order; regexes run over words joined by single spaces."""
    out: list[tuple[int, str, str, str]] = []
    say = r"(?:version |ver |v ?)?"
    under = r"(?:licensed under|released under|distributed under|available under|subject to|covered by|governed by|under the terms of)(?: the)?"

    # names whose versions are written as "version 2", "v2" or "2.0"
    families = [
        ("gpl", "general public", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public license", ("1.0", "2.0", "3.0")),
        ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public license", ("2.0", "2.1", "3.0")),
        ("agpl", "general public", r"(?:gnu )?affero general public license", ("1.0", "3.0")),
        ("gfdl", "free documentation", r"(?:gnu )?free documentation license", ("1.1", "1.2", "1.3")),
        ("apache", "apache", r"apache(?: software)?(?: license)", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", r"mozilla public license", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", r"eclipse public license", ("1.0", "2.0")),
        ("cddl", "distribution license", r"common development and distribution license", ("1.0", "1.1")),
        ("cpl", "common public", r"common public license", ("1.0",)),
        ("eupl", "european union", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
        ("osl", "open software", r"open software license", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic free", r"academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("bsl", "boost", r"boost software license", ("1.0",)),
        ("artistic", "artistic", r"artistic license", ("1.0", "2.0")),
        ("ofl", "open font", r"(?:sil )?open font license", ("1.0", "1.1")),
        ("odbl", "database", r"open (?:data commons open )?database license", ("1.0",)),
        ("cecill", "cecill", r"cecill(?: free software)?(?: license)?", ("1.0", "2.0", "2.1")),
        ("lppl", "latex", r"latex project public license", ("1.0", "1.2", "1.3")),
        ("zpl", "zope", r"zope public license", ("1.1", "2.0", "2.1")),
        ("php", "php", r"php license", ("3.0", "3.01")),
        ("python", "python", r"python(?: software foundation)? license", ("2.0",)),
        ("ms-pl", "microsoft", r"microsoft public license", ("1.0",)),
        ("busl", "business source", r"business source license", ("1.1",)),
        ("sspl", "server side", r"server side public license", ("1.0",)),
    ]
    for label, keyword, name, versions in families:
        for v in versions:
            major, _, minor = v.partition(".")
            number = rf"{major}(?: {minor})?" if minor in ("0", "") else rf"{major} {minor}"
            tag = f"{label}-{v}"
            out += _rules_of(
                0, keyword,
                [
                    (tag, rf"{under} {name},? {say}{number}(?: or (?:any )?later(?: version)?)?"),
                    (tag, rf"{name} as published by the free software foundation either {say}{number}")
                ]
            )
            out += _rules_of(1, keyword, [(tag, rf"{name} {say}{number}"), (f"{tag}-or-later", rf"{name} {say}{number} or (?:\(at your option\) )?(?:any )?later")])
        out += _rules_of(2, keyword, [(label, name)])
    for label, versions in (("gpl", ("1", "2", "3")), ("lgpl", ("2", "2 1", "3")), ("agpl", ("1", "3"))):
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}" + (".0" if " " not in v else "")
            out += _rules_of(1, label, [(tag, rf"(?:gnu )?{label} ?{say}{v}(?: 0)?")])
        out += _rules_of(2, label, [(label, rf"(?:gnu )?{label}")])

    # identifiers
    for tag in (
        "mit", "mit 0", "isc", "zlib", "unlicense", "wtfpl", "cc0 1 0", "0bsd", "ncsa", "bsl 1 0", "postgresql", "x11", "apache 2 0", "apache 1 1", "mpl 2 0",
        "epl 2 0", "epl 1 0"
    ):
        out += _rules_of(0, "spdx", [(tag.replace(" ", "-", 1).replace(" ", "."), rf"spdx license identifier {tag}")])
    for family, v, later in product(("gpl", "lgpl", "agpl"), ("2 0", "2 1", "3 0"), ("", " only", " or later")):
        out += _rules_of(0, "spdx", [(f"{family}-{v.replace(' ', '.')}{later.replace(' ', '-')}", rf"spdx license identifier {family} {v}{later}")])
    for n in (2, 3, 4):
        out += _rules_of(0, "spdx", [(f"bsd-{n}-clause", rf"spdx license identifier bsd {n} clause")])

    # creative commons
    parts = {
        "by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s",
        "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"
    }
    for (kind, words), v in product(parts.items(), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        tag = f"cc-{kind}-{v.replace(' ', '.')}"
        short = kind.replace("-", " ")
        out += _rules_of(0, "cc by", [(tag, rf"{under} (?:a )?(?:creative commons )?cc {short} {v}")])
        out += _rules_of(1, "cc by", [(tag, rf"cc {short} {v}")])
        out += _rules_of(0, "creative commons", [(tag, rf"creative commons {words}(?: license)?(?: {v}| {v} international| {v} unported)")])
    for kind, words in parts.items():
        out += _rules_of(2, "cc by", [(f"cc-{kind}", rf"cc {kind.replace('-', ' ')}")])
        out += _rules_of(2, "creative commons", [(f"cc-{kind}", rf"creative commons {words}")])
    out += _rules_of(1, "cc0", [("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?")])
    out += _rules_of(1, "creative commons", [("cc0-1.0", r"creative commons zero(?: v?1 0)?")])

    # bsd and short permissive texts
    for n, word in ((2, "two|2|simplified|freebsd"), (3, "three|3|new|revised|modified"), (4, "four|4|original")):
        out += _rules_of(1, "bsd", [(f"bsd-{n}-clause", rf"(?:{word})(?: clause)? bsd(?: style)?(?: license)?"), (f"bsd-{n}-clause", rf"bsd (?:{word}) clause(?: license)?")])
    out += _rules_of(2, "bsd", [("bsd", r"bsd(?: style)? licen[cs]ed?")])
    out += _rules_of(0, "redistribution", [("bsd", r"redistribution and use in source and binary forms with or without modification are permitted")])
    out += _rules_of(0, "permission", [
        ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ])
    for label, keyword, name in (
        ("mit", "mit", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa"),
        ("x11", "x11", "x11"), ("postgresql", "postgresql", "postgresql"), ("ruby", "ruby", "ruby"), ("perl", "perl", "perl"),
        ("openssl", "openssl", "openssl"), ("json", "json", "json"), ("curl", "curl", "curl"), ("upl", "universal permissive", "universal permissive"),
        ("ecl", "educational community", "educational community"), ("wtfpl", "do what the", "do what the fuck you want to public")
    ):
        out += _rules_of(0, keyword, [(label, rf"{under} {name} (?:open source )?licen[cs]e")])
        out += _rules_of(1, keyword, [(label, rf"{name} (?:open source |style |public )?licen[cs]ed?")])
    out += _rules_of(1, "wtfpl", [("wtfpl", "wtfpl")]) + _rules_of(1, "unlicense", [("unlicense", r"(?:the )?unlicense")]) + _rules_of(
        1, "unencumbered", [("unlicense", r"free and unencumbered software released into the public domain")]
    )

    # reserved, proprietary and public-domain notices
    out += _rules_of(1, "rights reserved", [("all-rights-reserved", r"all rights reserved"), ("some-rights-reserved", r"some rights reserved")])
    out += _rules_of(1, "public domain", [("public-domain", rf"(?:{verb}) (?:in|into|to) the public domain") for verb in ("placed", "released", "dedicated", "donated", "is")])
    out += _rules_of(2, "public domain", [("public-domain", r"public domain")])
    out += _rules_of(1, "proprietary", [("proprietary", r"proprietary (?:and confidential|license|software)"), ("proprietary", r"confidential and proprietary")])
    out += _rules_of(2, "copyright", [("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"), ("copyright", r"copyright c")])
    out += _rules_of(2, "licensed under", [("license-notice", r"licensed under(?: the)?")])
    out += _rules_of(2, "end user", [("eula", r"end user licen[cs]e agreement")])
    return tuple(sorted(out, key=lambda r: r[0]))


@cache
def gate() -> tuple[str, ...]:
    """Strings of which every match of any rule holds one: "licen" if the rule always has it outside its groups, else the rule's keyword."""
    out = {"licen"}
    for _, keyword, _, pattern in rules():
        bare = pattern
        while (less := re.sub(r"\([^()]*\)\??", "|", bare)) != bare:
            bare = less
        if "licen" not in bare:
            out.add(keyword)
    return tuple(sorted(out))


def words_line(text: Column) -> Column:
    """The words of a text between single spaces, a space at each end; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), _NOT_WORD, " ")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def stretches(line: Column) -> Column:
    """Distinct stretches of a word line with the words around them: begin and end (characters at which a match may begin), and text."""
    units = F.split(line, "(?<= )")  # a space, then each word with its space

    def cut(u: Column) -> Column:
        def one(i: Column) -> Column:
            at = i * CORE + 2
            back = F.greatest(at - REACH, F.lit(2))
            join = lambda a, n: F.array_join(F.slice(u, a, n), "")
            begin = F.length(join(back, at - back)) + 1
            return F.struct(
                begin.alias("begin"), (begin + F.length(join(at, F.lit(CORE)))).alias("end"),
                F.concat(F.lit(" "), join(back, at - back + CORE + REACH)).alias("text")
            )

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(u) - 1) / CORE).cast("int")), one)

    return F.array_distinct(F.element_at(F.transform(F.array(units), cut), 1))


def line_labels(stretch: Column, table_: Column) -> Column:
    """Labels of the matches that begin in a stretch and stand after suppression, with their rank."""
    line = stretch["text"]

    def spans(rule: Column) -> Column:
        regex = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
        pieces, found = F.split(line, regex, -1), F.regexp_extract_all(line, regex, F.lit(0))

        def span(m: Column, i: Column) -> Column:
            total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
            start = total(pieces, i + 1) + total(found, i)
            return F.struct(start.alias("start"), (-start - F.length(m)).alias("minus_end"), rule["rank"].alias("rank"), rule["label"].alias("label"))

        return F.transform(found, span)

    live = F.filter(table_, lambda r: F.contains(line, r["keyword"]))
    every = F.array_sort(F.flatten(F.transform(live, spans)))
    # sorted by start, longest first: a span lies inside an earlier one if that reaches its end
    none = F.array().cast("array<struct<rank:int,label:string>>")
    start = F.struct(F.lit(1).alias("r0"), F.lit(1).alias("r1"), F.lit(1).alias("r2"), none.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        inside = (a["r0"] <= x["minus_end"]) | ((x["rank"] >= 1) & (a["r1"] <= x["minus_end"])) | ((x["rank"] >= 2) & (a["r2"] <= x["minus_end"]))
        it = F.struct(x["rank"].alias("rank"), x["label"].alias("label"))
        kept = F.when(inside | (x["start"] < stretch["begin"]) | (x["start"] >= stretch["end"]), a["kept"]).otherwise(F.array_distinct(F.concat(a["kept"], F.array(it))))
        reach = lambda r: F.when((x["rank"] == r) & ~inside, F.least(a[f"r{r}"], x["minus_end"])).otherwise(a[f"r{r}"])
        return F.struct(reach(0).alias("r0"), reach(1).alias("r1"), reach(2).alias("r2"), kept.alias("kept"))

    return F.aggregate(every, start, step, lambda a: a["kept"])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs but text_col and those of the names that follow, and n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row for each input row; a null or empty text has no words and no labels. Equal stretches of
    one text are looked at once.
    """
    keep = [c for c in docs.columns if c not in {text_col, *RESULT}]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.struct(*keep).alias("_rest"), words_line(text).alias("_w"))
    phrases = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    named = named.withColumn("_n", _spaces(F.col("_w")) - 1).withColumn("_licensed", F.contains("_w", F.lit(" license ")))
    base = F.when(F.col("_licensed"), F.regexp_extract_all("_w", F.lit(phrases), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = named.withColumn("_base", base).withColumn("_pieces", F.when(F.size("_base") > 0, F.split("_w", phrases, -1)))
    gated = "|".join(gate())
    table_ = F.array(
        *[
            F.struct(F.lit(rank).alias("rank"), F.lit(keyword).alias("keyword"), F.lit(label).alias("label"), F.lit(regex).alias("regex")) for rank, keyword,
            label, regex in rules()
        ]
    )
    live = F.filter(stretches(F.col("_w")), lambda x: F.rlike(x["text"], F.lit(gated)))
    named = named.withColumn("_live", F.when(F.rlike("_w", F.lit(gated)), live))
    found = F.when(
        F.size("_live") > 0, F.array_distinct(F.flatten(F.transform("_live", lambda x: line_labels(x, table_))))
    ).otherwise(F.array().cast("array<struct<rank:int,label:string>>"))
    named = named.withColumn("_found", found)
    labels_of = F.create_map(*[x for k, v in BASE.items() for x in (F.lit(k), F.lit(v))])
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda p: labels_of[p])))
    last = F.element_at("_base", -1)
    rank = F.array_min(F.transform("_found", lambda x: x["rank"]))
    score = F.when(rank == 0, CONFIDENCE[0]).when((rank == 1) | (F.size("_base") > 0), CONFIDENCE[1]).when(rank == 2, CONFIDENCE[2]).otherwise(0.0)
    return named.select(
        "_rest.*", F.col("_n").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.when(F.size("_base") > 0, _spaces(F.element_at("_pieces", 1)) - 1).alias("first_word"),
        F.when(F.size("_base") > 0, F.col("_n") - (_spaces(F.element_at("_pieces", -1)) - 1) - (_spaces(last) + 1)).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("_found", lambda x: x["label"])))), ",").alias("labels"),
        score.alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and base phrases of every document (-1 for places where there are none)."""
    places = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("first_word", "last_word")]
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", *places, "base_labels")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, [i FOR i IN range(1, len(w)) IF w[i] = 'mit' AND w[i + 1] = 'license'] AS mit, [i FOR i IN range(1, len(w)) IF w[i] = 'apache' AND w[i + 1] = 'license'] AS apache,
    [i FOR i IN range(1, len(w) - 1) IF w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'] AS gpl FROM d
), a AS (SELECT *, mit || apache || gpl AS every FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, coalesce(list_min(every), 0) - 1 AS first_word, coalesce(list_max(every), 0) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM a
"""
