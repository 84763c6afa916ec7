"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items are hashed into a set that is broadcast. Texts are cut into
stretches of STRIDE words (and the words that their last windows need), every window of a stretch is
hashed and looked up in the set, and a hit counts only if the words themselves agree. A set of more
than SET_BYTES is dealt by hash into shards, each broadcast in a scan of its own; the way of a hit is
the same at every size. The same scan hands on every row once. Contaminated texts, known by two
hashes of 64 bits, lose their covered words (cut_spans), or go (remove_contaminated).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import ascii_lower, free_name, materialize, table

#: Words of a window.
WINDOW = 10
#: Words of a stretch.
STRIDE = 256
#: Most bytes of the windows that one scan broadcasts.
SET_BYTES = 32 << 20
#: Most texts whose hashes are broadcast to filter the rows in place; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as _NOT_WORD, before A-Z are lower-cased
_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + _GAP
_SPANS = "array<struct<at:int,end:int>>"


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def text_keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text, named k1 and k2."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, len, key (the window's words joined by spaces), items (ids of the items that hold it; null ids left out): one row for each window.

    Items without words have none.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    keys = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    each = items.select("item_id", size.alias("len"), F.explode(keys).alias("key"))
    return each.groupBy("len", "key").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64(_hashed(F.split("key", " "))).alias("h"), "len", "key", "items")


def _scan(rows: DataFrame, windows: DataFrame, lens: list[int]) -> DataFrame:
    """row, rest, n_words, at, len, items: a row with len 0 for each of rows (row, rest, w), and one for each place of a window.

    Words are hashed once; a window's hash is that of its words' hashes. The join with the broadcast
    windows finds them by hash and compares their words.
    """
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 1) / STRIDE).cast("int"))),
        lambda s: F.struct((s * STRIDE).alias("base"), F.slice("w", s * STRIDE + 1, F.lit(STRIDE + WINDOW - 1)).alias("w"))
    )
    stretches = rows.select("row", F.col("rest").alias("all"), F.size("w").alias("n_words"), F.explode(cut).alias("s")).select(
        "row", F.when(F.col("s.base") == 0, F.col("all")).alias("rest"), "n_words", "s.base", "s.w", _hashed(F.col("s.w")).alias("v")
    )
    none = F.array().cast("array<bigint>")

    def hashes(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.least(F.size("v") - n + 1, F.lit(STRIDE)))
        got = F.when(F.size("v") >= n, F.transform(starts, lambda i: F.xxhash64(F.slice("v", i, F.lit(n))))).otherwise(none)
        return F.struct(F.lit(n).alias("n"), got.alias("hs"))

    first = F.struct(F.lit(0).alias("n"), F.when(F.col("base") == 0, F.array(F.lit(0).cast("long"))).otherwise(none).alias("hs"))
    each = stretches.select(
        "row", "rest", "n_words", "base", "w", F.explode(F.array(first, *map(hashes, lens))).alias("x")
    ).select("row", "rest", "n_words", "base", "w", "x.n", F.posexplode("x.hs").alias("i", "h"))
    each = each.select("row", F.when(F.col("n") == 0, F.col("rest")).alias("rest"), "n_words", "base", "w", "n", "i", "h")
    same = (each["h"] == windows["h"]) & (F.col("n") == F.col("len")) & (F.col("key") == F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " "))
    return each.join(F.broadcast(windows), same).select("row", "rest", "n_words", (F.col("base") + F.col("i")).alias("at"), "len", "items")


def found(rows: DataFrame, benchmark: DataFrame, text: Column) -> DataFrame:
    """rest (a column of rows), n_words, items (sorted ids of the items found), spans (start and end of covered words): one row for each of rows; items and spans are null without a hit."""
    spark = rows.sparkSession
    windows = materialize(item_windows(benchmark), "decontam-windows")
    lens = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most WINDOW numbers
    per_row = F.octet_length("key") + 64 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    shards = max(1, -(-(windows.agg(F.sum(per_row.cast("long"))).first()[0] or 0) // SET_BYTES))
    words = rows.select(F.monotonically_increasing_id().alias("row"), "rest", words_of(text).alias("w"))
    if shards > 1:
        words = materialize(words, "decontam-words")  # several scans must see the same row numbers
    itself = spark.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"), F.lit("").alias("key"), F.array().cast("array<string>").alias("items"))
    parts = []
    for s in range(shards):
        mine = windows.filter(F.pmod("h", F.lit(shards)) == s)
        parts.append(materialize(_scan(words, mine.unionByName(itself) if s == 0 else mine, lens), "decontam-scan"))
    every = reduce(DataFrame.unionByName, parts)
    each = every.filter("len > 0").groupBy("row").agg(
        F.collect_set("items").alias("items"), F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).cast("int").alias("end")))).alias("at")
    )
    start = F.struct(F.array().cast(_SPANS).alias("done"), F.lit(None).cast("struct<at:int,end:int>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        join = acc["open"].isNotNull() & (x["at"] <= acc["open"]["end"])
        done = F.when(join | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        now = F.when(join, F.struct(acc["open"]["at"].alias("at"), F.greatest(acc["open"]["end"], x["end"]).alias("end"))).otherwise(x)
        return F.struct(done.alias("done"), now.alias("open"))

    spans = F.aggregate("at", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    sure = each.select("row", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), spans.alias("spans"))
    return parts[0].filter("len = 0").select("row", "rest", F.col("n_words").cast("long").alias("n_words")).join(sure, "row", "left").drop("row")


def _covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["at"]))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns (but the text and those of the names that follow), n_words, n_hit, items (sorted ids of items found), and spans (start and end of covered words).

    One row for each input row, repeats included. Null and empty texts have no words; items with a
    null id mark words but aren't named. A benchmark without words marks nothing.
    """
    keep = [c for c in docs.columns if c not in {text_col, "n_words", "n_hit", "items", "spans"}]
    rest = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    out = found(docs.select(rest.alias("rest"), F.col(text_col).alias("text")), benchmark, F.col("text"))
    return out.select(
        *[F.col(f"rest.`{c}`") for c in keep], "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )


def text_hits(docs: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """k1, k2, n_words, spans: one row for each distinct text with a hit."""
    rows = docs.select(F.struct(*text_keys(F.col(text_col))).alias("rest"), F.col(text_col).alias("text"))
    got = found(rows, benchmark, F.col("text")).filter("spans IS NOT NULL")
    return got.select("rest.k1", "rest.k2", "n_words", "spans").dropDuplicates(["k1", "k2"])


def _keyed(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with the hashes of their texts under free names."""
    a, b = free_name(docs, "_k1"), free_name(docs, "_k2")
    k1, k2 = text_keys(F.col(text_col))
    return docs.withColumn(a, k1).withColumn(b, k2), a, b


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs without those of whose words more than the share lies in benchmark windows; with a share of 0, those with any hit.

    An item of fewer than WINDOW words is one window, so with a share of 0 even an item of one word
    removes every document with that word. Null and empty texts stay; repeated rows stay or go
    together; an empty benchmark removes nothing. Documents never move: the hashes of the texts that
    go are broadcast, up to BROADCAST_TEXTS of them.
    """
    over = text_hits(docs, benchmark, text_col).filter(_covered(F.col("spans")) > share * F.col("n_words"))
    bad = materialize(over.select(F.col("k1").alias("_b1"), F.col("k2").alias("_b2")), "decontam-bad")
    keyed, a, b = _keyed(docs, text_col)
    few = bad.count() <= BROADCAST_TEXTS
    return keyed.join(F.broadcast(bad) if few else bad, (F.col(a) == F.col("_b1")) & (F.col(b) == F.col("_b2")), "left_anti").drop(a, b)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the words of benchmark windows taken out of text_col; what stands between words stays, but for the gap before each word that goes.

    One row for each input row; null and empty texts, and those without a hit, stay as they are.
    """
    names = docs.columns
    keyed, a, b = _keyed(docs, text_col)
    spans = free_name(docs, "_spans")
    hit = text_hits(docs, benchmark, text_col).select(F.col("k1").alias("_b1"), F.col("k2").alias("_b2"), F.col("spans").alias(spans))
    tokens = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_TOKEN), F.lit(0))
    led = F.regexp_like(F.col(text_col).cast("string"), F.lit("^" + _GAP)).cast("int")  # does a gap come first

    def kept(token: Column, j: Column) -> Column:
        word = F.floor((j + 1 - led) / 2)  # the number of a word, and for a gap that of the word after it
        return ~F.exists(spans, lambda s: (s["at"] <= word) & (word < s["end"]))

    cut = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(tokens, kept), ""))
    out = keyed.join(hit, (F.col(a) == F.col("_b1")) & (F.col(b) == F.col("_b2")), "left")
    return out.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in names])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM bi
), lens AS (SELECT DISTINCT n FROM bw
), di AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT DISTINCT di.doc_id, bw.item_id, di.n, di.i FROM di JOIN bw ON di.n = bw.n AND di.k = bw.k
), cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
