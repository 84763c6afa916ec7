"""PII, language, licenses, toxicity and pages."""

import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.llm import html, langid, licenses, pii, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    luhn = lambda d: sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    keep = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15
    }
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m.group())] for k, p in PATTERNS.items()}


TEXTS = [
    "a@b.c@d.e", "a@b.c+d@e.f x@y", "1.2.3.4.5.6.7.8", "300.1.1.1 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (523) 555-1055.", "+1", "+12 3456789 4111111111111111 0.0.0.0",
    "x" * 3000 + "@a.b", "1" * 3000, "1 " * 3000, "+" * 100 + "1 2", "é.x@ü.de ü@a-b.c-d", "a@b..c", "@a.b", "1.2.3.4@5.6",
]


@pytest.mark.parametrize("text", TEXTS)
def test_plain_spans(text):
    assert pii.plain_spans(text) == plain(text)


def test_plain_spans_of_documents(sf):
    for text in pd.read_parquet(f"{sf}/documents.parquet").text:
        assert pii.plain_spans(text) == plain(text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("x: john at mail dot example dot com ok", "email", "john at mail dot example dot com"),
    ("call plus one five five five one two three four five six seven please", "phone", "plus one five five five one two three four five six seven"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("ip 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"), ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguised(text, kind, found):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every[kind]] == [found] and base[kind] != every[kind]


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("call plus four, nine, one, seven, zero, one, two, three, four, five.", "phone", "plus four, nine, one, seven, zero, one, two, three, four, five"),
    ("call plus four,nine,one,seven,zero,one,two,three,four,five ok", "phone", "plus four,nine,one,seven,zero,one,two,three,four,five"),
    ("call plus four.nine.one.seven.zero.one.two.three.four.five ok", "phone", "plus four.nine.one.seven.zero.one.two.three.four.five"),
    ("call plus 4 nine 1 seven 0 one 2 three 4 five ok", "phone", "plus 4 nine 1 seven 0 one 2 three 4 five"),
])
def test_spelled_with_marks_or_digits(text, kind, found):
    assert [text[a:b] for a, b in pii.find(text)[1][kind]] == [found]
    assert found not in pii.redact_text(text)


@pytest.mark.parametrize("text", ["look at this. dot com", "one two three", "meet me at noon", "Der Punkt (at) all", "at dot at dot", "résumé naïve"])
def test_clean(text):
    assert pii.find(text)[1] == {k: [] for k in pii.KINDS}


def test_pii_rows(docs_of, odd_texts, as_dict):
    docs = docs_of([*odd_texts, "a@b.cd 1.2.3.4"])
    got = as_dict(pii.detect(docs))
    assert len(got) == len(odd_texts) + 1 and got[len(odd_texts)]["spans"] == "email:0:6,ip:7:14" and got[0]["spans"] == ""
    red = pii.redact(docs)
    assert red.columns == docs.columns
    row = as_dict(red)[len(odd_texts)]
    assert (row["text"], row["n_chars"]) == ("<EMAIL> <IP>", 12) and as_dict(red)[0]["text"] is None
    assert pii.detect(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()
    assert "n_chars" in red.columns and as_dict(red)[0]["n_chars"] is None and as_dict(red)[1]["text"] == ""


def test_disguised_addresses_of_any_length():
    name, host = " dot ".join(["part"] * 9), " dot ".join(["sub"] * 7 + ["com"])
    for text in (f"{name} at {host}", f"{'a' * 90} at example dot com", f"a at {'h' * 80} dot com"):
        assert pii.find(f"x, {text}, y")[1]["email"] == [(3, 3 + len(text))]


def test_pii_is_linear():
    for text in (
        "a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1 " * 100_000, "(" * 300_000, "one " * 30_000, "a dot " * 60_000, "a at " * 60_000,
        "aa at " + "bb dot " * 60_000 + "_"
    ):
        at = time.time()
        pii.find(text)
        assert time.time() - at < 20


def test_langid(spark, docs_of, odd_texts, as_dict):
    """Accuracy on held-out rows alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs)
    held = docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    rows = langid.identify(held, net).join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    got = as_dict(langid.identify(docs_of(odd_texts), net))
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[4]["lang_pred"] in net.langs and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs_of(["abc"]), None).collect()} == {"und"}


def test_langid_windows_cover_whole_texts():
    net = langid.fit(["aaaa bbbb" * 50, "cccc dddd" * 50], ["x", "y"], steps=60)
    lang, _ = net.predict(["aaaa bbbb " * 20 + "cccc dddd " * 3000, None, "cccc"])
    assert lang == ["y", "und", "y"]


def test_langid_forward_pass():
    """Filter by filter and place by place the same as the gathers."""
    import numpy as np

    net = langid.fit(["aaaa bbbb" * 50, "cccc dddd" * 50], ["x", "y"], filters=5, steps=30)
    buf, counts = langid.lay_out([langid.to_bytes("Ünder the bridge 123 " * 20), langid.to_bytes("ab")])
    assert counts.tolist() == [2, 1]
    want = np.array([
        [max(sum(net.filters[k][j][buf[at + i + j]][f] for j in range(k)) for i in range(langid.WINDOW)) for k in langid.WIDTHS for f in range(5)]
        for at in range(0, len(buf) - langid._PAD, langid.WINDOW)
    ])
    assert np.allclose(net.maxima(buf), want, atol=1e-4)
    z = np.maximum(want, 0) @ net.dense + net.bias
    assert np.allclose(net.shares(buf), np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), atol=1e-4)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_licenses(docs_of, odd_texts, as_dict):
    texts = [
        *odd_texts, "MIT License", "the mit  LICENSE, mit-license; Apache\nLicense general public license x", "transmit license", "mit licensed", "mit license" * 3, "Éapache license",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "This work is licensed under the GNU General Public License, version 3.",
        "GNU Lesser General Public License v2.1", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "MIT License\n" * 3000, "Copyright 2020",
    ]
    got = as_dict(licenses.scan(docs_of(texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t[:40] if t else t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    label = {texts[i]: got[i]["labels"].split(",") for i in got}
    assert label["Licensed under the Apache License, Version 2.0."] == ["apache", "apache-2.0"]
    assert label["SPDX-License-Identifier: MIT"] == ["mit"]
    assert label["This work is licensed under the GNU General Public License, version 3."] == ["gpl", "gpl-3.0"]
    assert label["GNU Lesser General Public License v2.1"] == ["gpl", "lgpl-2.1"]  # the base label stays
    assert label["Licensed under CC BY-NC 4.0."] == ["cc-by-nc-4.0"] and label["Copyright 2020"] == ["copyright"]
    assert len(licenses.rules()) > 300 and licenses.scan(docs_of(["a"]).limit(0)).count() == 0
    assert not any(r["labels"] for i, r in got.items() if i < len(odd_texts))


def samples(pattern):
    """Two texts that a rule matches: first choices without optional parts, last choices with all of them."""
    def walk(items, full):
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                yield chr(arg)
            elif name == "IN":
                first, last = arg[0][1], arg[-1][1]
                pick = last if full else first
                yield chr(pick if isinstance(pick, int) else pick[0])
            elif name == "MAX_REPEAT":
                yield from (x for _ in range(arg[1] if full else arg[0]) for x in walk(arg[2], full))
            elif name == "SUBPATTERN":
                yield from walk(arg[3], full)
            elif name == "BRANCH":
                yield from walk(max(arg[1], key=len) if full else arg[1][0], full)
            else:
                assert name == "ASSERT_NOT"

    tree = re._parser.parse(pattern)
    return {" ".join(re.findall("[a-z0-9]+", "".join(walk(tree, full)))) for full in (False, True)}


def slow_labels(text):
    """All rules over all words, with neither gate nor keywords nor stretches."""
    line = " " + " ".join(re.findall("[a-z0-9]+", text.lower())) + " "
    spans = sorted((m.start(), -m.end(), rank, label) for rank, _, label, p in licenses.rules() for m in re.finditer(f"(?<= )(?:{p})(?= )", line))
    kept, reach = set(), [1, 1, 1]
    for _, end, rank, label in spans:
        if all(end < reach[r] for r in range(rank + 1)):
            kept.add(label)
            reach[rank] = end
    return kept | {label for p, label in licenses.BASE.items() if f" {p} " in line}


def test_every_license_rule(docs_of, as_dict):
    """A positive text for each rule: on one line, and wrapped at every word amid long prose."""
    texts = []
    for _, keyword, _, pattern in licenses.rules():
        for t in samples(pattern):
            line = f" {t} "
            if re.search(f"(?<= )(?:{pattern})(?= )", line):
                assert keyword in line and any(g in line for g in licenses.gate()) and len(t.split()) < licenses.REACH, pattern
                texts.append(t)
    assert all(any(re.search(f"(?<= )(?:{p})(?= )", f" {t} ") for t in samples(p)) for _, _, _, p in licenses.rules())
    texts = list(dict.fromkeys(texts))
    wrapped = ["qq " * (90 + i % 60) + t.replace(" ", "\n") + " zz" * 200 for i, t in enumerate(texts)]
    got = as_dict(licenses.scan(docs_of(texts + wrapped)))
    for i, t in enumerate(texts + wrapped):
        assert set(filter(None, got[i]["labels"].split(","))) == slow_labels(t) != set() and got[i]["score"] > 0, t


def test_wrapped_licenses(docs_of, as_dict):
    texts = [
        "Licensed under the Apache\nLicense, Version 2.0", "GNU Lesser General Public\nLicense v2.1",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles",
        "Proprietary and confidential"
    ]
    got = as_dict(licenses.scan(docs_of(texts)))
    assert [got[i]["labels"] for i in range(4)] == ["apache,apache-2.0", "gpl,lgpl-2.1", "mit", "proprietary"]


def test_license_plan_is_native(docs_of):
    plan = licenses.scan(docs_of(["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_toxicity_model(spark, sf, docs_of, odd_texts):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").collect()  # held out
    assert len(rows) > 60
    guess = model.scores([r["text"] for r in rows]) >= 0.5
    toxic = [bool(r["toxic"]) for r in rows]
    assert sum(g == t for g, t in zip(guess, toxic, strict=True)) / len(rows) > 0.93
    assert sum(g and not t for g, t in zip(guess, toxic, strict=True)) <= 0.02 * len(rows)
    assert (model.scores(["you idiot moron, you stupid loser"]) > model.scores(["a fine day for all of us"])).all()
    made = docs_of(odd_texts)
    scored = toxicity.with_score(made, model)
    assert scored.columns == [*made.columns, "_toxicity"] and all(0 <= r["_toxicity"] <= 1 for r in scored.collect())
    assert toxicity.drop_toxic(made, labels.limit(0)).count() == len(odd_texts)
    clash = made.withColumn("_toxicity", F.lit("x")).withColumn("_TOXICITY_", F.lit(1))
    kept = toxicity.drop_toxic(clash, labels)
    assert kept.columns == clash.columns and kept.count() > 0
    assert toxicity.drop_toxic(made.limit(0), labels).count() == 0 and toxicity.train(made.limit(0), labels).scores([None]).shape == (1,)
    assert (toxicity.train(docs, labels.filter("toxic = 0")).scores(["x"]) == 0).all()


def test_isotonic_rises():
    import numpy as np

    x, y = toxicity.isotonic(np.arange(50.0), (np.arange(50) % 7 > 3).astype(float))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()


def test_isotonic_pools_ties():
    import numpy as np

    score, y = np.array([1.0] * 100 + [0.0] * 40 + [2.0] * 40), np.array([0.0] * 90 + [1.0] * 10 + [0.0] * 40 + [1.0] * 40)
    for order in (np.arange(180), np.arange(180)[::-1], np.random.default_rng(0).permutation(180)):
        x, p = toxicity.isotonic(score[order], y[order])
        assert np.interp(1.0, x, p) == pytest.approx(10.25 / 100.5) and np.interp(0.0, x, p) < 0.01 and np.interp(2.0, x, p) > 0.99
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 12, 300).astype(float), (rng.random(300) < 0.4).astype(float)
    values = np.unique(score)
    mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
    least = [max(min(mean(a, b) for b in values[values >= v]) for a in values[values <= v]) for v in values]  # the min-max formula
    x, p = toxicity.isotonic(score, y)
    assert np.allclose(np.interp(values, x, p), least, atol=0.03)


def test_one_tree_is_the_best_split():
    """A tree of depth 1 takes the cut with the least loss of all, with values g / (h + 1)."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 3, 200) > 11).astype(float)
    got = toxicity.Trees(rounds=1, depth=1, rate=1.0).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    gain = lambda k, c: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, k] <= c, x[:, k] > c))
    best = max(((k, c) for k in range(3) for c in range(19)), key=lambda kc: gain(*kc))
    feat, cut, value = got.trees[0]
    assert (feat[0], cut[0]) == best
    for node, side in ((1, x[:, best[0]] <= best[1]), (2, x[:, best[0]] > best[1])):
        assert value[node] == pytest.approx(g[side].sum() / (h[side].sum() + 1))
        assert np.allclose(got.predict(x[side]), got.start + value[node])


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>The &amp; title</h1><p>Some <b>bold</b>
 text &lt;here&gt; &#233;.</p><aside>see also</aside><div class="ad">Buy</div><p>x</p><ul><li>One</li><li>Two</li></ul><section class="comments"><p>First!</p></section></article><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_pages_tree_uses_neighbours():
    """The tree is grown on blocks of labelled pages, and the same page reads otherwise without its neighbours."""
    import numpy as np

    x, y = html.training_table()
    assert (html.classify(x) == y).mean() > 0.99

    def used(node):
        return set() if len(node) == 1 else {html.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert used(html.tree()) & {"words_before", "links_before"} and used(html.tree()) & {"words_after", "links_after"}
    menu = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(20))
    page = f"<nav>{menu}</nav><article><h1>A title</h1><p>{'text ' * 40}</p><p><a href=x>One link</a></p><p>{'more ' * 40}</p><ul>{menu}</ul><p>{'last ' * 30}</p></article><footer>end</footer>"
    lines = html.main_text(page).split("\n")
    assert [line.split()[0] for line in lines] == ["A", "text", "One", "more", "last"]
    found = html.blocks(page)
    alone = html.block_features(found)
    alone[:, 2:6] = 0
    assert (html.classify(alone) != html.classify(html.block_features(found))).any()
    assert not np.array_equal(html.grow(np.delete(x, [2, 3, 4, 5], 1), y), html.tree())


def test_pages_without_article():
    links = "".join(f"<a href=x>Menu {i}</a><br>" for i in range(6))
    page = f"<div>{links}</div><h1>The title of this page here now</h1><div>{'first ' * 50}</div><div>{'second ' * 40}</div><div>{'third ' * 60}</div><div>{links}</div><p>Imprint</p>"
    assert [line.split()[0] for line in html.main_text(page).split("\n")] == ["The", "first", "second", "third"]
    assert html.main_text(
        "<article><p>Let <math><mi>x</mi></math> be</p><p class=legal>law</p><svg><text>fig</text></svg><div class=share>s</div></article>"
    ) == "Let x be\nlaw\nfig"


def test_pages(spark, sf):
    assert html.main_text(PAGE) == "The & title\nSome bold text <here> é.\nx\nOne\nTwo"
    assert html.main_text(None) == "" == html.main_text("") == html.main_text("<p") and html.main_text("<nav>a</nav>") == ""
    assert html.main_text("<p>" + "plain words with no article at all " * 5) == ("plain words with no article at all " * 5).strip()
    assert html.main_text("<article><p>a<p>b" + "<div>" * 20000 + "deep") == "a\nb\ndeep"
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 6), (None, None, None, 7)], "page_id long, url string, html string, text int")
    rows = html.extract(pages).collect()
    assert [r["n_chars"] for r in sorted(rows, key=lambda r: r["n_chars"])] == [0, *[len(html.main_text(PAGE))] * 2] and html.extract(pages.limit(0)).count() == 0
    for h in pd.read_parquet(f"{sf}/pages.parquet").html:
        inner = re.search(r"<article>(.*)</article>", h, re.S).group(1)
        lines = [" ".join(html.decode(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert html.main_text(h) == "\n".join(filter(None, lines))
