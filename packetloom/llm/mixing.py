"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times on average, at most
MAX_COPIES times. The whole part is taken outright; the rest is a probability. Pivotal rounding
pairs two open probabilities and moves words from one document to the other, in a random direction
that keeps both expectations, until one of them is settled at 0 or 1. The words of a pair stay the
same, so a source's total changes only when the last open document is settled.

Documents are paired by falling size, so that the last open one is small. Groups of one source and
one salt leave one open document each; these meet in a tree until one is left of each source, which
is settled at the nearer of 0 and 1, so that its source's words miss the target by half of it at
most. Group, order and random numbers come from doc_id and size alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm._common import materialize, table

MAX_COPIES = 3
#: Documents that one group holds, about; a source of more is dealt over salts.
GROUP = 4096
#: Most rounds of the filling of targets, and most bytes of the table of sources that is broadcast.
FILL_ROUNDS = 200
BROADCAST_BYTES = 32 << 20
#: Groups whose open documents meet in one group of the next level.
FAN_IN = 64


def water_fill(sizes: list[int], weights: list[float], cap: float = MAX_COPIES) -> list[float]:
    """Targets that share the sum of sizes by weight, none above cap times its size: what is above is shared again (the plain way, for tests)."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = cap * float(sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with source_no, their rank by code point (null last): sorted in ranges, each range numbered from the number of rows before it."""
    ranged = sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "mixing-ranges")
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # one row for each task of the sort
    before, at = [], 0
    for k in sorted(counts):
        before += [F.lit(k), F.lit(at).cast("long")]
        at += counts[k]
    w = Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    start = F.create_map(*before)[F.col("range")] if before else F.lit(0).cast("long")
    return ranged.withColumn("source_no", start + F.row_number().over(w) - 1).drop("range")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_no, source_size, target, salts of each source of sized (source, size).

    Sources stay distributed. The level to which targets fill is found by Newton's method, one sum
    over the sources a round: sources above MAX_COPIES times their size are left at that, the others share the rest.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mixing-sources")
    ranked = materialize(_ranked(sums).withColumn("weight", 1 + F.col("source_no") % 3), "mixing-ranked")
    cap = F.col("source_size") * MAX_COPIES
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, last = 0.0, -1
    for _ in range(FILL_ROUNDS):
        over = F.col("weight") * F.lit(unit) > cap if unit else F.lit(False)
        weight, full, n = ranked.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap)), F.sum(over.cast("long"))).first()
        if n == last or not weight:
            break
        unit, last = (total - (full or 0)) / weight, n
    else:
        raise RuntimeError(f"targets not settled after {FILL_ROUNDS} rounds")
    target = F.least(F.col("weight") * F.lit(float(unit)), cap.cast("double")) if last is not None and unit else F.lit(0.0)
    return ranked.select(
        "source", "source_no", "source_size", target.alias("target"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("docs") / GROUP)).cast("int").alias("salts")
    )


def _coin(key: int, other: int) -> float:
    return xxhash.xxh64_intdigest(f"{key}:{other}", 11) / 2**64


class _Pivot:
    """The open document of a group, and what has been settled."""

    def __init__(self) -> None:
        self.open: tuple | None = None  # index, key, size, probability

    def add(self, index: int, key: int, size: int, p: float) -> list[tuple[int, int]]:
        """Meets the open document with another; gives (index, 0 or 1) of those that were settled."""
        if size == 0 or p <= 1e-12 or p >= 1 - 1e-12:
            return [(index, int(size > 0 and p > 0.5))]
        if self.open is None:
            self.open = (index, key, size, p)
            return []
        i, k, s, q = self.open
        up = min((1 - q) * s, p * size)  # words that may go to the open document
        down = min(q * s, (1 - p) * size)  # or from it
        move = up if _coin(k, key) * (up + down) < down else -down
        q, p = q + move / s, p - move / size
        done, left = [], []
        for x in ((i, k, s, q), (index, key, size, p)):
            if x[3] <= 1e-9 or x[3] >= 1 - 1e-9:
                done.append((x[0], int(x[3] > 0.5)))
            else:
                left.append(x)
        self.open = left[0] if left else None
        return done


_COLUMNS = "row long, key long, source_no long, salt int, size long, p double, whole int, extra int"
_OUT = pa.schema(
    [
        ("row", pa.int64()), ("key", pa.int64()), ("source_no", pa.int64()), ("salt", pa.int32()), ("size", pa.int64()), ("p", pa.float64()),
        ("whole", pa.int32()), ("extra", pa.int32())
    ]
)


def _settle(group: tuple[str, ...], last: bool):  # noqa: ANN202
    """Arrow function over rows sorted by group and falling size; extra stays null for each group's open document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, current, held = _Pivot(), None, None  # held: the open document's row

        def finish() -> list[tuple]:
            nonlocal held
            out = []
            if pivot.open is not None and held is not None:
                p = pivot.open[3]
                extra = int(p >= 0.5) if last else None
                out = [(*held[:5], p, held[6], extra)]
            pivot.open, held = None, None
            return out

        for b in batches:  # a few numbers a row
            done: list[tuple] = []
            rows = list(zip(*(b.column(i).to_pylist() for i in range(len(_OUT))), strict=True))
            at = {n: i for i, n in enumerate(b.schema.names)}
            for j, r in enumerate(rows):
                g = tuple(r[at[c]] for c in group)
                if g != current:
                    done += finish()
                    current = g
                before = held
                for index, extra in pivot.add(j, r[1], r[4], r[5]):
                    x = r if index == j else before
                    done.append((*x[:7], extra))
                if pivot.open is not None and pivot.open[0] == j:
                    held = r
                if pivot.open is None:
                    held = None
                else:
                    pivot.open = (-1, *pivot.open[1:])
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, x, strict=True)) for x in done], schema=_OUT)
        if rest := finish():
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, x, strict=True)) for x in rest], schema=_OUT)

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (default: all), size, source_size, target and copies (0 to MAX_COPIES), by how often the mix takes each row.

    Null texts and texts without words have size 0 and are taken as often as the whole part says.
    A null source is a source of its own, the last. Rows with the same id, size and text are settled
    apart, in any order. An empty table gives none.
    """
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    rest = F.struct(*[c for c in carry or docs.columns if c not in {"_size", "_source_size", "_target", "_copies"}])
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"),
        size.alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), rest.alias("rest")
    )
    slim = materialize(slim, "mixing-sized")
    per_source = materialize(targets(slim), "mixing-targets")
    numbered = per_source.withColumnRenamed("source", "s")
    size_of = per_source.agg(F.sum(F.octet_length(F.coalesce("source", F.lit(""))).cast("long") + 64)).first()[0] or 0
    numbered = F.broadcast(numbered) if size_of <= BROADCAST_BYTES else numbered
    rows = slim.select("row", "id", "source", "size", "hash").join(numbered, F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(rate + 1e-12).cast("int")
    rows = rows.select(
        "row", F.xxhash64("id", "size", "hash").alias("key"), "source_no",
        F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), "size", F.greatest(F.lit(0.0), rate - whole).alias("p"), whole.alias("whole"), F.lit(None).cast("int").alias("extra"),
        "source_size", "target",
    )
    rows = materialize(rows, "mixing-rows")
    kept = rows.select("row", "source_size", "target", "whole")
    open_, settled = rows.drop("source_size", "target"), []
    most = per_source.agg(F.max("salts")).first()[0] or 1
    level = 0
    while True:
        group = ("source_no", "salt")
        order = (*group, F.desc("size"), "key", "row")
        now = open_.repartition(*group).sortWithinPartitions(*order).select(*_OUT.names).mapInArrow(_settle(group, last=most == 1), _COLUMNS)
        now = materialize(now, f"mixing-level{level}")
        settled.append(now.filter("extra IS NOT NULL").select("row", "extra"))
        if most == 1:
            break
        open_ = now.filter("extra IS NULL").withColumn("salt", (F.col("salt") / FAN_IN).cast("int"))
        most = -(-most // FAN_IN)
        level += 1
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    out = slim.join(kept.join(every, "row"), "row")
    return out.select(
        "rest.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        (F.col("whole") + F.col("extra")).alias("_copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix: each row of docs as often as it is taken, with the number of the copy (_copy, from 1, in place of a column of that name).

    Columns of docs that are named as those of copies give way. Nulls, empty texts, repeats and empty
    tables are as in copies.
    """
    got = copies(docs).filter("_copies > 0")
    own = {"_copy", "_size", "_source_size", "_target", "_copies"}
    return got.select(*[c for c in docs.columns if c not in own], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    got = copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken")
    )


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and its source, and the source's target."""
    got = copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 4).alias("target"))


# the level is that of the first source, by rising cap a weight, that it doesn't fill
TARGETS_ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (
  SELECT 3.0 * n / w AS r, coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(n) OVER () AS total FROM s
), u AS (SELECT CAST(total - filled AS DOUBLE) / CAST(rest AS DOUBLE) AS unit FROM o WHERE (total - filled) / rest <= r ORDER BY r LIMIT 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(least(w * unit, CAST(3 * n AS DOUBLE)), 4) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, u
"""
