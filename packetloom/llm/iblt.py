"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text is cut into pieces at every line and sentence end; a piece that stays longer than LONG is cut
further after words that their own hash picks (in words of over LONG, after such pairs of
characters), so that an edit changes only the pieces around it. The digest of each distinct piece goes
into one cell of each of three parts of a table, and a cell keeps the number, the exclusive-or of
its digests and of their check sums. The fingerprint is that table, of BASE cells. Two tables
subtract cell by cell; peeling cells that hold one digest recovers the digests of which the versions
differ. Where that fails, larger sketches are made and tried: the digests are dealt by hash into
groups of about GROUP, each with a table of the first of LEVELS; a group that gets stuck is tried
again with the next, under other hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm._common import materialize, table

BASE = 24
#: Cells of the larger sketches' tables, and how many digests of both texts a group holds about.
LEVELS = (24, 96, 384, 1536)
GROUP = 12
#: Characters of a piece or word beyond which it is cut by content, and one of how many words (pairs of characters) ends a piece.
LONG = 300
EVERY = 16
#: Bytes of text in a range of documents, about, and the most cuts of each of two levels (beyond SIDE * SIDE ranges, ranges grow).
RANGE_BYTES = 4 << 20
SIDE = 512
_CUT = r"\n|(?<=[.!?]) |(?<=[。！？])"
_ROUNDS = 14
_CELLS = "array<struct<n:int,k:bigint,c:bigint>>"


def _by_content(piece: Column) -> Column:
    """A piece cut after each word (in words of over LONG, each pair of characters) whose hash is a multiple of EVERY."""
    ends = lambda x: F.pmod(F.xxhash64(x), F.lit(EVERY)) == 0

    def within(word: Column) -> Column:
        paired = lambda c: F.zip_with(c, F.concat(F.array(F.lit("")), c), lambda x, before: F.when(x.isNull(), "").when(ends(F.concat(before, x)), F.concat(x, F.lit("\n"))).otherwise(x))
        return F.element_at(F.transform(F.array(F.split(word, "")), lambda c: F.array_join(paired(c), "")), 1)

    words = F.transform(
        F.split(piece, " "),
        lambda w: F.when(F.length(w) > LONG, F.concat(within(w), F.lit(" "))).when(ends(w), F.concat(w, F.lit("\n"))).otherwise(F.concat(w, F.lit(" ")))
    )
    return F.split(F.array_join(words, ""), "\n")


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text, sorted; none for an empty text."""
    pieces = F.split(text, _CUT)
    pieces = F.when(
        F.exists(pieces, lambda p: F.length(p) > LONG),
        F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > LONG, _by_content(p)).otherwise(F.array(p))))
    ).otherwise(pieces)
    pieces = F.filter(pieces, lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


_EMPTY = "struct<n:int,k:bigint,c:bigint>"


def _signed(keys: Column, n: int) -> Column:
    """Digests with their check sums, counted n each."""
    return F.transform(keys, lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"), _check(k).alias("c")))


def _placed(items: Column, cells: int) -> Column:
    """Counted digests with their cell in each of three parts; a table's hash follows its size."""
    third = cells // 3

    def place(x: Column) -> Column:
        h = lambda: F.xxhash64(x["k"], F.lit(cells))
        at = [F.shiftright(h(), 20 * j).bitwiseAND(F.lit(third - 1).cast("long")).cast("int").alias(f"p{j}") for j in range(3)]
        return F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), *at)

    return F.transform(items, place)


def _stretch(cells: int) -> int:
    """Cells of large tables are looked after in stretches of about the root of a part's number, so that few digests are tried for each."""
    third = cells // 3
    return third if third <= 8 else max(d for d in range(1, third + 1) if third % d == 0 and d * d <= third)


def _by_cell(placed: Column, cells: int, cell) -> Column:  # noqa: ANN001
    """The array of cell(number, digests placed there) of all parts."""
    third, size = cells // 3, _stretch(cells)

    def part(j: int) -> Column:
        def within(s: Column | int, near: Column) -> Column:
            first = s * size if isinstance(s, int) else s * F.lit(size)
            numbers = F.sequence(F.lit(first), F.lit(first + size - 1)) if isinstance(s, int) else F.sequence(first, first + (size - 1))
            return F.transform(numbers, lambda i: cell(i + j * third, F.filter(near, lambda x: x[f"p{j}"] == i)))

        if size == third:
            return within(0, placed)

        def stretch(s: Column) -> Column:
            near = F.filter(placed, lambda x: F.floor(x[f"p{j}"] / size).cast("int") == s)
            return F.element_at(F.transform(F.array(near), lambda n: within(s, n)), 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(third // size - 1)), stretch))

    return F.concat(*map(part, range(3)))


def _add(a: Column, x: Column) -> Column:
    return F.struct((a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))


def _minus(x: Column, y: Column) -> Column:
    return F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))


def _table(items: Column, cells: int) -> Column:
    """The table of counted digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")).cast(_EMPTY)
    # the placed digests are bound once, as the only element of an array
    return F.element_at(F.transform(F.array(_placed(items, cells)), lambda p: _by_cell(p, cells, lambda _, mine: F.aggregate(mine, empty, _add))), 1)


def sketch(keys: Column, cells: int) -> Column:
    """The table of a set of digests."""
    return _table(_signed(keys, 1), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _minus)


def peel(cells: Column, size: int) -> Column:
    """Struct of the numbers of digests only in the first and only in the second table; null if peeling gets stuck."""
    start = F.struct(cells.cast(_CELLS).alias("cells"), F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(True).alias("go"))

    def round_(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))))

        def take(found: Column) -> Column:
            rebuilt = F.element_at(
                F.transform(F.array(_placed(found, size)), lambda p: _by_cell(p, size, lambda i, gone: F.aggregate(gone, F.get(state["cells"], i), _minus))), 1
            )
            left = F.when(F.size(found) > 0, rebuilt).otherwise(state["cells"])
            ones = F.size(F.filter(found, lambda x: x["n"] == 1))
            return F.struct(
                left.cast(_CELLS).alias("cells"), (state["first"] + ones).alias("first"), (state["second"] + F.size(found) - ones).alias("second"),
                (F.size(found) > 0).alias("go")
            )

        return F.when(state["go"], F.element_at(F.transform(F.array(pure), take), 1)).otherwise(state)

    def finish(state: Column) -> Column:
        clean = ~F.exists(state["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
        return F.when(clean, F.struct(state["first"].alias("first"), state["second"].alias("second")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, round_, finish)


def _larger(a: Column, b: Column) -> Column:
    """Peels larger sketches of two texts, group by group of digests, each of the least of LEVELS that peels; null if a group gets stuck in all."""
    groups = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / GROUP)).cast("int")
    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"))

    def dealt(n: Column) -> Column:
        s = F.ceil(F.sqrt(n)).cast("int")  # groups lie in rows of about the root of their number, so that few digests are tried for each

        def place(x: Column) -> Column:
            g = F.pmod(F.xxhash64(x["k"], F.lit(5)), n).cast("int")
            return F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), F.floor(g / s).cast("int").alias("row"), F.pmod(g, s).alias("col"))

        items = F.transform(F.concat(_signed(a, 1), _signed(b, -1)), place)

        def group(mine: Column) -> Column:
            return F.when(F.size(mine) == 0, none).otherwise(F.coalesce(*[peel(_table(mine, m), m) for m in LEVELS]))

        def row(near: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), s - 1), lambda j: F.element_at(F.transform(F.array(F.filter(near, lambda x: x["col"] == j)), group), 1))

        def rows(every: Column) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.element_at(F.transform(F.array(F.filter(every, lambda x: x["row"] == i)), row), 1)))

        each = F.element_at(F.transform(F.array(items), rows), 1)
        sums = lambda e: F.aggregate(e, none, lambda t, x: F.struct((t["first"] + x["first"]).alias("first"), (t["second"] + x["second"]).alias("second")))
        return F.element_at(F.transform(F.array(each), lambda e: F.when(~F.exists(e, lambda x: x.isNull()), sums(e))), 1)

    return F.element_at(F.transform(F.array(groups), dealt), 1)


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared digests over all digests of two texts, 0 to 1, from the peeled differences of their sketches; 1 for two empty texts.

    Null if some group of digests gets stuck in tables of all LEVELS (a chance of about one in 10**13).
    """
    # a table can't hold more digests than it has cells: the numbers say when only a larger sketch can do
    differ = F.coalesce(F.when(F.abs(F.size(a) - F.size(b)) <= BASE, peel(subtract(cells_a, cells_b), BASE)), _larger(a, b))
    got = F.element_at(F.transform(F.array(differ), lambda d: (F.size(a) - d["first"]) / F.greatest(F.lit(1), F.size(a) + d["second"])), 1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(got)


def serial(keys: Column, cells: Column) -> Column:
    """The fingerprint as text: number of digests, then each cell's count, digest and check sum in hex."""
    hexed = F.transform(cells, lambda x: F.when(x["n"] == 0, F.lit("")).otherwise(F.concat_ws(".", x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"])))))
    return F.concat_ws(":", F.size(keys).cast("string"), F.array_join(hexed, ","))


def _ranged(rows: DataFrame, range_bytes: int) -> DataFrame:
    """rows (doc_id, text) with rank (their order) and bucket (rising with the rank, of about range_bytes of text).

    Cuts have two levels, so that neither holds more than SIDE: the first is part of the expression,
    the second a broadcast table of a row for each stretch of the first. An id that fills whole
    ranges, or null, is dealt over buckets by the leading bits of its texts' hash, in which order its rows stand.
    """
    order = F.struct(
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("a"), F.col("doc_id").isNotNull().alias("b"), F.xxhash64("text").alias("c"),
        F.xxhash64(F.lit(1), F.col("text")).alias("d")
    )
    rows = rows.withColumn("rank", order)
    size, n, nulls = rows.agg(F.sum(F.octet_length("text").cast("long") + 64), F.count(F.lit(1)), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    ranges = max(1, (size or 0) // range_bytes)
    side = min(SIDE, int(ranges**0.5 + 0.999))
    shares = [i / side for i in range(1, side)] or [0.5]
    first = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 100 * SIDE)).first()[0] or [])) if side > 1 else []
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in first]), lambda c: c <= F.col("doc_id"))) if first else F.lit(0)
    rows = rows.withColumn("coarse", F.when(F.col("doc_id").isNotNull(), coarse))
    second = rows.filter("coarse IS NOT NULL").groupBy("coarse").agg(F.percentile_approx("doc_id", shares, 10 * SIDE).alias("fine"))
    rows = rows.join(F.broadcast(second), "coarse", "left")  # SIDE rows of SIDE numbers at most
    part = F.shiftright("rank.c", 54) + 512
    hot = F.size(F.filter("fine", lambda c: c == F.col("doc_id"))) > 1
    within = F.when(F.col("doc_id").isNull(), part if (nulls or 0) * ranges > n else F.lit(0)).when(hot, part).otherwise(2047)
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.col("coarse") * (side + 1) + F.size(F.filter("fine", lambda c: c <= F.col("doc_id"))))
    return rows.select("doc_id", "text", "rank", (at.cast("long") * 2048 + within).alias("bucket"))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, keys and those of the next row by falling doc_id (null ids last, equal ids by their texts' hashes); the first follows the last.

    Rows are dealt by ranges of doc_id, in one shuffle; each range also gets a copy of the first row
    of the range that follows it, so neighbours never have to be looked for elsewhere.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = _ranged(rows, range_bytes)
    heads = ranged.groupBy("bucket").agg(F.max("rank").alias("rank"))
    falling = Window.orderBy(F.desc("bucket"))  # one row for each range
    follows = heads.select(
        F.col("bucket").alias("to"), F.coalesce(F.lead(F.struct("bucket", "rank")).over(falling), F.first(F.struct("bucket", "rank")).over(falling)).alias("x")
    )
    follows = materialize(follows.select("to", F.col("x.bucket").alias("of"), F.col("x.rank").alias("head")), "fingerprints-heads")
    copies = ranged.join(
        F.broadcast(follows), (F.col("bucket") == F.col("of")) & (F.col("rank") == F.col("head"))
    ).select("doc_id", "text", "rank", F.col("to").alias("bucket")).dropDuplicates(["bucket"])
    every = ranged.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    w = Window.partitionBy("bucket").orderBy("copy", F.desc("rank"))
    keyed = every.withColumn("keys", digests(F.col("text")))
    led = keyed.select("doc_id", "text", "keys", "copy", F.lead(F.struct("text", "keys")).over(w).alias("next"))
    return led.filter(~F.col("copy")).select("doc_id", "text", "keys", F.col("next.text").alias("next_text"), F.col("next.keys").alias("next_keys"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each input row.

    Null texts are empty. Repeated ids are separate rows, ordered by a hash of their texts. An empty
    table has no rows; a single row is its own next.
    """
    rows = with_next(docs)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    rows = rows.select(
        "*", sketch(F.col("keys"), BASE).alias("cells"), sketch(F.col("edited_keys"), BASE).alias("edited_cells"),
        sketch(F.col("next_keys"), BASE).alias("next_cells")
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", serial(F.col("keys"), F.col("cells")).alias("fingerprint"), serial(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("cells"), F.col("next_cells")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document."""
    return fingerprint_versions(table(spark, sf_dir, "documents"))
