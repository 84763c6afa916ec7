"""Registered queries of the engine's own operators, with SQL that gives the same rows.

The tables hold no audio, so the column functions that the decoder uses are applied to them: events
are packets (user_id the stream, event_id their order, value a level), embeddings are spectra or
channels, and line items are raw integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import bits, headers, vectors
from packetloom.operators import compare
from packetloom.plans import timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The size class of an event's packet, samples in it, and whether it ends a page.
_COUNT = "(event_id % 7) * 64"
_PAGE_END = "event_id % 5 = 0"
_PAGE_POSITION = "event_id * 100"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RAW = "(l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber) % 4294967296"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RAW).alias("raw"))


@query("""
SELECT event_id, user_id, CAST(trunc(greatest(-32768.0, least(32767.0, (value - 100) / 150 * 32768))) AS SMALLINT) AS sample FROM events
""")
def pcm_quantize_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float samples to 16 bits."""
    return _t(spark, sf_dir, "events").select("event_id", "user_id", vectors.quantize((F.col("value") - 100) / 150).alias("sample"))


@query("SELECT event_id, user_id, value / 500 AS sample FROM events")
def pcm_passthrough_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float samples as they are."""
    return _t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 500).alias("sample"))


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN raw = 0 THEN 0 ELSE length(bin(raw)) END AS INTEGER) AS bits,
  CAST(CASE WHEN l_linenumber = 0 THEN 0 ELSE length(bin(l_linenumber)) END AS INTEGER) AS small_bits FROM r
""")
def ilog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer logarithm."""
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", bits.ilog(F.col("raw")).alias("bits"), bits.ilog(F.col("l_linenumber")).alias("small_bits"))


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN (raw >> 31) & 1 = 1 THEN -1 ELSE 1 END) * CAST(raw & 2097151 AS DOUBLE) * pow(2.0, ((768 + ((raw >> 21) & 31)) - 788)) AS value FROM r
""")
def packed_float_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed floats of moderate exponents."""
    moderate = F.expr("(raw & 2097151) | ((768 + (shiftright(raw, 21) & 31)) * 2097152) | ((shiftright(raw, 31) & 1) * 2147483648)")
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", bits.packed_float(moderate).alias("value"))


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, (raw >> 3) & 31 AS f5, (raw >> 7) & 65535 AS f16, (raw >> 1) & 1 AS flag, raw & 16777215 AS f24 FROM r
""")
def bit_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned fields, least significant bit first."""
    x = F.col("raw")
    return _raw(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", bits.bit_field(x, 3, 5).alias("f5"), bits.bit_field(x, 7, 16).alias("f16"), bits.bit_field(x, 1, 1).alias("flag"),
        bits.bit_field(x, 0, 24).alias("f24")
    )


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, (raw & 127) - CASE WHEN raw & 64 > 0 THEN 128 ELSE 0 END AS s7, (raw & 255) - CASE WHEN raw & 128 > 0 THEN 256 ELSE 0 END AS s8,
  raw - CASE WHEN raw >= 2147483648 THEN 4294967296 ELSE 0 END AS s32 FROM r
""")
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed fields."""
    x = F.col("raw")
    return _raw(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", bits.sign_extend(x, 7).alias("s7"), bits.sign_extend(x, 8).alias("s8"), bits.sign_extend(x, 32).alias("s32")
    )


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(list_sum([((raw >> i) & 1) * (2147483648 >> i) FOR i IN range(32)]) AS BIGINT) AS reversed FROM r
""")
def bit_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 bits in reverse."""
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", bits.bit_reverse(F.col("raw")).alias("reversed"))


@query("SELECT l_orderkey, l_linenumber, CAST(pow(2, l_linenumber) AS BIGINT) - 1 AS low, CASE WHEN l_linenumber % 8 = 0 THEN 255 ELSE CAST(pow(2, l_linenumber % 8) AS BIGINT) - 1 END AS byte_mask FROM lineitem")
def bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the low bits."""
    n = F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.low_mask(n).alias("low"), bits.byte_mask(n % 8).alias("byte_mask"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey * 50 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, e, CAST(list_max([x FOR x IN range(0, 2000) IF x * x <= e]) AS BIGINT) AS r2, CAST(list_max([x FOR x IN range(0, 400) IF x * x * x <= e]) AS BIGINT) AS r3,
  CAST(list_max([x FOR x IN range(0, 100) IF x * x * x * x <= e]) AS BIGINT) AS r4 FROM r
""")
def nth_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer roots, as in the number of lookup values of a codebook."""
    e = F.col("l_partkey") + F.col("l_suppkey") * 50
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e"), *[bits.nth_root(e, d).alias(f"r{d}") for d in (2, 3, 4)])


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, ({_RAW}) % 10000 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(x // 1000 % 10 AS INTEGER) AS d0, CAST(x // 100 % 10 AS INTEGER) AS d1, CAST(x // 10 % 10 AS INTEGER) AS d2, CAST(x % 10 AS INTEGER) AS d3 FROM r
""")
def radix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification words as digits, most significant first."""
    d = bits.radix_digits(F.col("raw") % 10000, 10, 4)
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", *[F.col("d")[i].alias(f"d{i}") for i in range(4)])


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS n, sum(pow(2.0, -(1 + (l_partkey + l_linenumber) % 6))) AS kraft, min(1 + (l_partkey + l_linenumber) % 6) AS least FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, kraft, CASE WHEN n = 1 THEN CASE WHEN least = 1 THEN 'ok' ELSE 'InvalidSingleEntry' END WHEN kraft > 1 THEN 'Overspecified' WHEN kraft < 1 THEN 'Underpopulated' ELSE 'ok' END AS status FROM r
""")
def kraft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of a tree from its codeword lengths alone."""
    return headers.tree_status(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], 1 + (F.col("l_partkey") + F.col("l_linenumber")) % 6)


def _neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to 64 values of a stream, as in a floor's list of positions."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = _t(spark, sf_dir, "events").select(
        "user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"), F.floor((F.row_number().over(w) - 1) / 64).alias("run")
    )
    prefix = Window.partitionBy("user_id", "run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("seen", F.collect_list("x").over(prefix))


_NEIGHBOR_SQL = """
WITH r AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS x, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 64 AS run FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS i FROM r),
n AS (SELECT a.user_id, a.run, a.event_id, a.x, {best}(b.x) AS neighbor FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND a.run = b.run AND b.i < a.i AND b.x {op} a.x GROUP BY ALL)
SELECT n.user_id, n.event_id, n.x, coalesce(n.neighbor, -1) AS neighbor, coalesce(min(s.i), -1) AS at FROM n LEFT JOIN s ON n.user_id = s.user_id AND n.run = s.run AND n.neighbor = s.x GROUP BY ALL
"""


@query(_NEIGHBOR_SQL.format(best="max", op="<"))
def prefix_low_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest smaller value among those before."""
    found, at = bits.prefix_neighbor(F.col("seen"), F.col("x"), low=True)
    return _neighbors(spark, sf_dir).select("user_id", "event_id", "x", F.coalesce(found, F.lit(-1)).alias("neighbor"), F.coalesce(at, F.lit(-1)).alias("at"))


@query(_NEIGHBOR_SQL.format(best="min", op=">"))
def prefix_high_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest larger value among those before."""
    found, at = bits.prefix_neighbor(F.col("seen"), F.col("x"), low=False)
    return _neighbors(spark, sf_dir).select("user_id", "event_id", "x", F.coalesce(found, F.lit(-1)).alias("neighbor"), F.coalesce(at, F.lit(-1)).alias("at"))


_LINE = """
WITH p AS (SELECT user_id, event_id, CAST(round(value) AS BIGINT) AS y0, CAST(event_id AS BIGINT) AS x0, lead(event_id) OVER w AS x1, CAST(round(lead(value) OVER w) AS BIGINT) AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    y = F.round("value").cast("long")
    return _t(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("x0"), y.alias("y0"), F.lead("event_id").over(w).alias("x1"), F.lead(y).over(w).alias("y1")
    ).filter("x1 IS NOT NULL")


@query(_LINE + "SELECT user_id, event_id, CASE WHEN y1 >= y0 THEN y0 + (abs(y1 - y0) * ((x0 + x1) // 2 - x0)) // (x1 - x0) ELSE y0 - (abs(y1 - y0) * ((x0 + x1) // 2 - x0)) // (x1 - x0) END AS y FROM p WHERE x1 IS NOT NULL")
def render_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer interpolation half way between two events."""
    x = F.floor((F.col("x0") + F.col("x1")) / 2).cast("long")
    return _segments(spark, sf_dir).select("user_id", "event_id", bits.render_point(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), x).alias("y"))


@query(_LINE + ", q AS (SELECT *, unnest(range(x0, x1)) AS x FROM p WHERE x1 IS NOT NULL) SELECT user_id, x, CASE WHEN y1 >= y0 THEN y0 + (abs(y1 - y0) * (x - x0)) // (x1 - x0) ELSE y0 - (abs(y1 - y0) * (x - x0)) // (x1 - x0) END AS y FROM q")
def render_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer lines between events, one row for each position."""
    return timeline.lines(_segments(spark, sf_dir), ["user_id"])


@query(f"""
WITH c AS (SELECT *, sum({_COUNT}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events),
a AS (SELECT *, last_value(CASE WHEN {_PAGE_END} THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS e FROM c)
SELECT a.user_id, a.event_id, CAST(coalesce(c.event_id * 100 + a.cum - c.cum, -1) AS BIGINT) AS position FROM a LEFT JOIN c ON a.user_id = c.user_id AND a.e = c.event_id
""")
def granule_running_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position after each packet: anchored at page ends, running between."""
    got = timeline.position(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.expr(_COUNT), F.expr(_PAGE_END), F.expr(_PAGE_POSITION))
    return got.select("user_id", "event_id", F.coalesce("position", F.lit(-1)).alias("position"))


@query(f"""
WITH c AS (SELECT *, sum({_COUNT}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events)
SELECT user_id, event_id, CAST(cum - {_COUNT} AS BIGINT) AS start, CAST(trunc(greatest(-32768.0, least(32767.0, (value - 100) / 150 * 32768))) AS SMALLINT) AS sample FROM c WHERE cum > 1000
""")
def timeline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start position and 16-bit level of every packet after the first 1000 samples of its stream."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = _t(spark, sf_dir, "events").withColumn("cum", F.sum(F.expr(_COUNT)).over(w)).filter("cum > 1000")
    return rows.select("user_id", "event_id", (F.col("cum") - F.expr(_COUNT)).alias("start"), vectors.quantize((F.col("value") - 100) / 150).alias("sample"))


@query("""
SELECT vec_id, flatten([[embedding[i], embedding[i + 32]] FOR i IN range(1, 33)])[1] AS a, flatten([[embedding[i], embedding[i + 32]] FOR i IN range(1, 33)])[2] AS b, flatten([[embedding[i], embedding[i + 32]] FOR i IN range(1, 33)])[35] AS c,
  flatten([[embedding[i], embedding[i + 32]] FOR i IN range(1, 33)])[64] AS d FROM embeddings
""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels to one array."""
    planar = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", vectors.interleave(planar).alias("x"))
    return rows.select("vec_id", *[F.col("x")[i].alias(n) for n, i in (("a", 0), ("b", 1), ("c", 34), ("d", 63))])


@query("SELECT vec_id, embedding[1] AS a, embedding[3] AS b, embedding[2] AS c, embedding[64] AS d, 32 AS n FROM embeddings")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array to two channels."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", vectors.deinterleave(F.col("embedding"), 2).alias("x"))
    return rows.select(
        "vec_id", F.col("x")[0][0].alias("a"), F.col("x")[0][1].alias("b"), F.col("x")[1][0].alias("c"), F.col("x")[1][31].alias("d"),
        F.size(F.col("x")[1]).alias("n")
    )


@query("""
SELECT vec_id, unnest(range(0, 128)) AS n, round(list_sum([CAST(embedding[k + 1] AS DOUBLE) * cos(pi() / 64 * (n + 0.5 + 32) * (k + 0.5)) FOR k IN range(0, 64)]), 4) + 0.0 AS y
FROM (SELECT vec_id, embedding, unnest(range(0, 128)) AS n FROM embeddings)
""".replace("SELECT vec_id, unnest(range(0, 128)) AS n, round", "SELECT vec_id, n, round"))
def imdct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse transform of 64 lines to 128 samples, by the definition."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.imdct(F.col("embedding"), 64)).alias("n", "y"))
    return rows.select("vec_id", F.col("n").cast("long").alias("n"), (F.round("y", 4) + 0.0).alias("y"))


@query("""
SELECT event_id, CASE WHEN instr(props, ':') > 0 THEN substr(props, 1, instr(props, ':') - 1) END AS key, CASE WHEN instr(props, ':') > 0 THEN substr(props, instr(props, ':') + 1) END AS value FROM events
""")
def comment_kv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries split at the first separator."""
    key, value = headers.split_entry(F.col("props"), ":")
    return _t(spark, sf_dir, "events").select("event_id", key.alias("key"), value.alias("value"))


@query("""
WITH book AS (SELECT label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT event_id, CAST(event_id % 12 AS INTEGER) AS entry, v[1] AS first, v[64] AS last, v IS NULL AS unmapped FROM events LEFT JOIN book ON event_id % 12 = label
""")
def vq_dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry numbers to their vectors; entries without one are told apart."""
    book = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    rows = headers.look_up(_t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).cast("int").alias("entry")), book, "entry", "label", "v")
    return rows.select("event_id", "entry", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"), F.col("v").isNull().alias("unmapped"))


@query("""
WITH h AS (SELECT vec_id, unnest(range(1, 33)) AS i, embedding AS e FROM embeddings)
SELECT vec_id, i, CASE WHEN e[i] > 0 AND e[i + 32] <= 0 THEN e[i] + e[i + 32] WHEN e[i] <= 0 AND e[i + 32] <= 0 THEN e[i] - e[i + 32] ELSE e[i] END AS first,
  CASE WHEN e[i] > 0 AND e[i + 32] > 0 THEN e[i] - e[i + 32] WHEN e[i] <= 0 AND e[i + 32] > 0 THEN e[i] + e[i + 32] ELSE e[i] END AS second FROM h
""")
def inverse_couple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes and angles to two channels."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.inverse_couple(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("i", "p"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "p.first", "p.second")


@query("SELECT vec_id, i, embedding[i] * embedding[i + 32] AS y FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings)")
def spectrum_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor times residue."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.multiply(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("i", "y"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "y")


@query("SELECT i, round(sin(pi() / 2 * pow(sin(pi() / 2 * ((i + 0.5) / 1024)), 2.0)), 9) AS w FROM range(0, 1024) t(i)")
def window_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising window of 1024 values."""
    rows = spark.range(1).select(F.posexplode(vectors.window_slope(1024)).alias("i", "w"))
    return rows.select(F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))


@query("SELECT i, round(pow(10.0, 7.0 * (i + 1) / 256 - 7) * 1e7, 6) AS v FROM range(0, 256) t(i)")
def db_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor levels."""
    return spark.range(256).select(F.col("id").alias("i"), F.round(vectors.db_value(F.col("id")) * 1e7, 6).alias("v"))


_BARK = "(13.1 * atan(0.00074 * ({x})) + 2.24 * atan(0.0000000185 * ({x}) * ({x})) + 0.0001 * ({x}))"


@query(f"SELECT i, round(cos(pi() * least(255, floor({_BARK.format(x='21.533203125 * i')} * 256 / {_BARK.format(x='22050.0')})) / 256), 9) AS c FROM range(0, 1024) t(i)")
def bark_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bark scale of 1024 lines at 44100 Hz."""
    return spark.range(1024).select(F.col("id").alias("i"), F.round(vectors.bark_cos(F.col("id"), 1024, 44100, 256), 9).alias("c"))


_FLAGS = "event_type IN ('view', 'click', 'purchase')"


@query(f"""
WITH f AS (SELECT user_id, event_id, {_FLAGS} AS long, coalesce(lag({_FLAGS}) OVER w, false) AS prev, coalesce(lead({_FLAGS}) OVER w, false) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE WHEN long THEN 2048 ELSE 256 END AS n FROM f)
SELECT user_id, event_id, n, CASE WHEN long AND NOT prev THEN n // 4 - 64 ELSE 0 END AS "left", CASE WHEN long AND NOT prev THEN n // 4 + 64 ELSE n // 2 END AS left_end,
  CASE WHEN long AND NOT next THEN 3 * n // 4 - 64 ELSE n // 2 END AS "right", CASE WHEN long AND NOT next THEN 3 * n // 4 + 64 ELSE n END AS "end",
  CASE WHEN long AND NOT next THEN 3 * n // 4 - 64 ELSE n // 2 END - CASE WHEN long AND NOT prev THEN n // 4 - 64 ELSE 0 END AS samples FROM g
""")
def block_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window geometry and number of samples of blocks, without decoding."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    long = F.expr(_FLAGS)
    rows = _t(spark, sf_dir, "events").select(
        "user_id", "event_id", long.alias("long"), F.coalesce(F.lag(long).over(w), F.lit(False)).alias("prev"),
        F.coalesce(F.lead(long).over(w), F.lit(False)).alias("next")
    )
    rows = rows.withColumn("n", F.when(F.col("long"), 2048).otherwise(256))
    rows = rows.withColumn("g", vectors.block_geometry(F.col("n"), 256, F.col("long"), F.col("prev"), F.col("next")))
    return rows.select("user_id", "event_id", "n", "g.*", (F.col("g.right") - F.col("g.left")).alias("samples"))


@query("""
WITH b AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), x AS (SELECT *, unnest(range(1, 33)) AS i FROM b WHERE p IS NOT NULL)
SELECT label, vec_id, i, round(CAST(e[i] AS DOUBLE) * sin(pi() / 2 * pow(sin(pi() / 2 * ((i - 1 + 0.5) / 32)), 2.0)) + CAST(p[32 + i] AS DOUBLE) * sin(pi() / 2 * pow(sin(pi() / 2 * ((32 - i + 0.5) / 32)), 2.0)), 6) + 0.0 AS y FROM x
""")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each block's first half with the second half of the block before it; the first block gives nothing."""
    w = Window.partitionBy("label").orderBy("vec_id")
    half = F.transform(F.slice("embedding", 33, 32), lambda v: v.cast("double"))
    rows = _t(spark, sf_dir, "embeddings").select(
        "label", "vec_id", F.transform(F.slice("embedding", 1, 32), lambda v: v.cast("double")).alias("fresh"), F.lag(half).over(w).alias("before")
    )
    out = rows.select("label", "vec_id", F.posexplode(vectors.overlap_add(F.col("fresh"), F.col("before"), vectors.window_slope(32))).alias("i", "y"))
    return out.select("label", "vec_id", (F.col("i") + 1).cast("long").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"""
WITH c AS (SELECT *, {_COUNT} AS n, sum({_COUNT}) OVER w AS cum, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, n, CAST(CASE WHEN is_last THEN least(n, greatest(0, cum - n + 50 - (cum - n))) ELSE n END AS BIGINT) AS kept FROM c
""")
def end_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last packet of each stream, cut to the final position (50 samples into it)."""
    w, back = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = _t(spark, sf_dir, "events").select(
        "user_id", "event_id", F.expr(_COUNT).alias("n"), F.sum(F.expr(_COUNT)).over(w).alias("cum"), (F.row_number().over(back) == 1).alias("is_last")
    )
    before = F.col("cum") - F.col("n")
    return rows.select("user_id", "event_id", "n", timeline.end_trim(F.col("n"), before, before + 50, F.col("is_last")).alias("kept"))


@query(f"""
WITH c AS (SELECT user_id, event_id, {_COUNT} AS n, sum({_COUNT}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events),
h AS (SELECT *, cum > 1000 AND cum - n <= 1000 AS hit FROM c), l AS (SELECT *, lead(hit, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM h)
SELECT user_id, event_id, CASE WHEN hit THEN 'target' ELSE 'primer' END AS role, CAST(CASE WHEN hit THEN 1000 - (cum - n) ELSE -1 END AS BIGINT) AS leftover FROM l WHERE hit OR before
""")
def skip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear skip of 1000 samples: the packet to decode, and the one that primes it."""
    got = timeline.skip_samples(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.expr(_COUNT), 1000)
    return got.select("user_id", "event_id", "role", F.coalesce("leftover", F.lit(-1)).alias("leftover"))


@query(f"""
SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id, max(CASE WHEN {_PAGE_END} AND event_id * 100 <= 50000 THEN event_id END) AS page_at FROM events GROUP BY user_id) f USING (user_id) WHERE page_at IS NULL OR e.event_id > page_at
""")
def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets after the last page end at or before position 50000."""
    page = F.when(F.expr(_PAGE_END), F.expr(_PAGE_POSITION))
    return timeline.seek_page(_t(spark, sf_dir, "events"), ["user_id"], "event_id", page, 50_000).select("user_id", "event_id")


@query("""
WITH f AS (SELECT user_id, min_by(event_type, event_id) AS first FROM events GROUP BY user_id) SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN f USING (user_id) WHERE e.event_type = f.first
""")
def serial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each stream's first serial."""
    return timeline.first_serial_only(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH n AS (SELECT user_id, event_id, CAST(coalesce(event_type != lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS INTEGER) AS new FROM events)
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS link_idx FROM n
""")
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the link of a chain that each packet belongs to."""
    return timeline.chain_links(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type")).select("user_id", "event_id", "link_idx")


@query("""
WITH r AS (SELECT user_id, value AS a, round(value) AS b, event_id // 50 AS packet, event_id % 7 = 3 AS only_b, event_id % 90 = 4 AS only_a FROM events),
p AS (SELECT user_id, packet, max(CASE WHEN only_a OR abs(a - b) > 0.48 THEN 1 ELSE 0 END) AS far FROM r WHERE NOT only_b GROUP BY ALL),
e AS (SELECT user_id, CAST(count(CASE WHEN only_b AND NOT only_a THEN 1 END) AS BIGINT) AS extra FROM r GROUP BY ALL HAVING count(CASE WHEN NOT (only_a AND only_b) THEN 1 END) > 0)
SELECT e.user_id, count(far) AS packets, CAST(sum(far) AS BIGINT) AS differing, avg(far) * 100 AS percent, any_value(extra) AS extra FROM e LEFT JOIN p ON e.user_id = p.user_id GROUP BY e.user_id
""")
def tolerance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with a sample farther than a tolerance from a second decoder's (here: rounded values), or that either decoder lacks."""
    every = _t(spark, sf_dir, "events").select("user_id", "event_id", "value", F.floor(F.col("event_id") / 50).alias("packet"))
    b = every.filter("event_id % 90 <> 4").select("user_id", "event_id", F.round("value").alias("value"))
    return compare.tolerance_diff(every.filter("event_id % 7 <> 3"), b, ["user_id"], "event_id", "value", "packet", 0.48)


@query("""
SELECT a.vec_id, CAST(len([i FOR i IN range(1, 65) IF abs(a.embedding[i] - b.embedding[i]) >= CAST(0.1 AS FLOAT)]) AS INTEGER) AS differing FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""".replace("CAST(0.1 AS FLOAT)", "0.1::DOUBLE").replace("abs(a.embedding[i] - b.embedding[i])", "abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)"))
def eps_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where neighbouring vectors differ by 0.1 or more."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", vectors.eps_mismatch(F.col("v"), F.col("w"), 0.1).alias("differing"))


@query(f"SELECT user_id, count(*) AS packets, sum({_COUNT}) / 44100 AS seconds FROM events GROUP BY user_id")
def stream_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and seconds of each stream."""
    return compare.duration(_t(spark, sf_dir, "events"), ["user_id"], F.expr(_COUNT), F.lit(44100))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def integrity_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every content."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_type AS expected_status, count(*) AS n FROM events WHERE event_type != 'click' GROUP BY event_type")
def status_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose status isn't the expected one, counted by the expected status (here: click)."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.lit("click").alias("status"))
    expected = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("expected_status"))
    return compare.status_check(rows, expected, "event_id").groupBy("expected_status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH v AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM v),
k AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM r), s AS (SELECT *, CASE WHEN bad AND k % 2 = 1 THEN 'AudioBadFormat' ELSE 'ok' END AS status FROM k)
SELECT user_id, event_id, status, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id) = 'AudioBadFormat', false) AS restarts FROM s
""")
def slope_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of packets in runs of window mismatches."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return timeline.slope_status(rows, ["user_id"], "event_id", "bad").select("user_id", "event_id", "status", "restarts")


# Made-up files: one for each supplier, of six contents. Their rows in SQL are what plain decoders written from the
# specifications give (tests/test_plain.py computes them anew).

#: content, link_idx, serial, channels, packets, bytes, pages, last page's position; of the audio packets: number, samples of blocks, samples,
#: loudness in dB; packets after skipping 1000 samples, their samples, samples left to skip. Fixed values.
LINKS = """
(0, 0, 100, 1, 43, 2019, 9, 3062, 40, 6208, 3062, -9.78, 29, 2062, 0),
(1, 0, 101, 2, 43, 2135, 9, 3830, 40, 7936, 3830, -7.66, 27, 2830, 0),
(2, 0, 102, 1, 43, 2107, 9, 3446, 40, 6976, 3446, -11.7, 27, 2446, 0),
(2, 1, 502, 1, 23, 1177, 6, 1568, 20, 3200, 1568, -22.52, 6, 568, 0),
(3, 0, 103, 2, 43, 2040, 9, 3206, 40, 6592, 3206, -11.48, 29, 2206, 0),
(4, 0, 104, 1, 43, 2095, 9, 3302, 40, 6784, 3302, -10.18, 29, 2302, 0),
(5, 0, 105, 2, 43, 2110, 9, 3062, 40, 6208, 3062, -7.37, 25, 2062, 0),
(5, 1, 505, 2, 23, 1135, 6, 1568, 20, 3392, 1568, -7.03, 5, 568, 0)
"""
#: book, dims, entries, bits of all codewords, sum of the codewords as numbers, sum of the vectors. Fixed values.
BOOKS = """
(0, 2, 4, 9, 15, 0),
(1, 2, 9, 29, 50, 0.0),
(2, 1, 64, 384, 2016, 0),
(3, 1, 4, 8, 6, 0),
(4, 2, 4, 8, 6, 4.75)
"""
#: part, kind (null: the content modulo 3), idx, detail (null: 0 1; 0; 0; 0 for contents 3 and 5, else ; by the channels). Fixed values.
SETUP = """
('floor', 1, 0, '2 0 1; 0 128 12 40 25 90'),
('residue', NULL, 0, '0 96 8 2 0; 1 - - - - - - -; 1 1 - - - - - -'),
('mapping', 0, 0, NULL),
('mode', 0, 0, '0'),
('mode', 1, 1, '0')
"""
_FILES_SQL = "f AS (SELECT s_suppkey, 'made-up-' || s_suppkey || '.ogg' AS file, s_suppkey % 6 AS content FROM supplier)"
_LINK_COLUMNS = "content, link_idx, serial, channels, packets, bytes, pages, last_position, audio, n, samples, loudness, after, after_samples, leftover"
_LINK_SQL = f"WITH {_FILES_SQL}, l({_LINK_COLUMNS}) AS (VALUES {LINKS}) SELECT file, CAST(link_idx AS INTEGER) AS link_idx, {{}} FROM f JOIN l USING (content)"


def _made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.plans.decode import made_up_files
    from packetloom.sources.ogg import split_files

    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return split_files(made_up_files(suppliers, F.col("id") % 6))


@query(_LINK_SQL.format("CAST(serial AS BIGINT) AS serial, CAST(packets AS BIGINT) AS packets, CAST(bytes AS BIGINT) AS bytes, CAST(pages AS BIGINT) AS pages, CAST(last_position AS BIGINT) AS last_position"))
def ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, bytes, pages and last position of each link of the files."""
    got = _made_up(spark, sf_dir).groupBy("file", "link_idx", "serial")
    return got.agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("data").cast("long")).alias("bytes"), F.count_distinct("page_idx").alias("pages"),
        F.max("absgp_page").alias("last_position")
    )


@query(_LINK_SQL.format("CAST(channels AS SMALLINT) AS channels, CAST(44100 AS BIGINT) AS sample_rate, 0 AS bitrate_max, 112000 AS bitrate_nominal, 0 AS bitrate_min, CAST(6 AS TINYINT) AS bs0, CAST(8 AS TINYINT) AS bs1, 'ok' AS status"))
def ogg_stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ident header of each link."""
    from packetloom.plans.decode import stream_info

    return stream_info(_made_up(spark, sf_dir))


@query(f"""
WITH {_FILES_SQL}, l({_LINK_COLUMNS}) AS (VALUES {LINKS})
SELECT file, CAST(link_idx AS INTEGER) AS link_idx, 'packetloom' AS vendor, pos, key, CASE WHEN pos = 0 THEN 'file ' || content ELSE 'nobody=else' END AS value FROM f JOIN l USING (content), (VALUES (0, 'TITLE'), (1, 'ARTIST')) c(pos, key)
""")
def ogg_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each link."""
    from packetloom.plans.decode import comments

    return comments(_made_up(spark, sf_dir))


@query(f"""
WITH {_FILES_SQL}, l({_LINK_COLUMNS}) AS (VALUES {LINKS}), b(book, dims, entries, bits, codes, vq) AS (VALUES {BOOKS})
SELECT file, CAST(link_idx AS INTEGER) AS link_idx, book, dims, CAST(entries AS BIGINT) AS entries, CAST(bits AS BIGINT) AS bits, CAST(codes AS BIGINT) AS codes, CAST(vq AS DOUBLE) AS vq FROM f JOIN l USING (content), b
""")
def ogg_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, codewords and vectors of each codebook."""
    from packetloom.plans.decode import codebooks

    vq = F.aggregate(F.coalesce("vq", F.array().cast("array<float>")), F.lit(0.0), lambda a, x: a + x)
    got = codebooks(_made_up(spark, sf_dir)).groupBy("file", "link_idx", "book", "dims")
    return got.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("code_len").alias("bits"), F.sum(F.conv("codeword", 2, 10).cast("long")).alias("codes"),
        F.round(F.sum(vq), 3).alias("vq")
    )


@query(f"""
WITH {_FILES_SQL}, l({_LINK_COLUMNS}) AS (VALUES {LINKS}), s(part, kind, idx, detail) AS (VALUES {SETUP})
SELECT file, CAST(link_idx AS INTEGER) AS link_idx, part, idx, CAST(coalesce(kind, content % 3) AS INTEGER) AS kind,
  coalesce(detail, CASE WHEN content = 3 THEN '0 1' ELSE '' END || '; ' || CASE WHEN channels = 2 THEN '0 0' ELSE '0' END || '; 0; 0') AS detail FROM f JOIN l USING (content), s
""")
def ogg_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors, residues, mappings and modes of each link."""
    from packetloom.plans.decode import setup_summary

    return setup_summary(_made_up(spark, sf_dir))


@query(_LINK_SQL.format("CAST(audio AS BIGINT) AS packets, CAST(n AS BIGINT) AS n, CAST(samples AS BIGINT) AS samples, CAST(last_position AS BIGINT) AS position"))
def ogg_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, samples and last position of each link, from the first bytes of its packets."""
    from packetloom.plans.decode import shapes

    got = shapes(_made_up(spark, sf_dir)).groupBy("file", "link_idx")
    return got.agg(F.count(F.lit(1)).alias("packets"), F.sum("n").alias("n"), F.sum("samples").alias("samples"), F.max_by("position", "pkt_idx").alias("position"))


@query(_LINK_SQL.format("CAST(audio AS BIGINT) AS packets, CAST(samples AS BIGINT) AS samples, CAST(last_position AS BIGINT) AS position, CAST(loudness AS DOUBLE) AS loudness"))
def ogg_decode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and their loudness of each link, all packets decoded, positioned and trimmed."""
    from packetloom.plans.decode import decode

    flat = F.flatten("planar")
    rows = decode(_made_up(spark, sf_dir)).filter("status = 'ok'").select(
        "file", "link_idx", "pkt_idx", "samples", "position", F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("power"),
        F.size(flat).alias("values")
    )
    got = rows.groupBy("file", "link_idx").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("samples").alias("samples"), F.max_by("position", "pkt_idx").alias("position"), F.sum("power").alias("power"),
        F.sum("values").alias("values")
    )
    return got.select("file", "link_idx", "packets", "samples", "position", F.round(10 * F.log10(F.col("power") / F.col("values")), 2).alias("loudness"))


@query(_LINK_SQL.format("CAST(after AS BIGINT) AS packets, CAST(after_samples AS BIGINT) AS samples, CAST(leftover AS BIGINT) AS leftover"))
def ogg_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and samples of each link from sample 1000 on, and what is left to skip of a shorter one."""
    from packetloom.plans.decode import skip

    got = skip(_made_up(spark, sf_dir), 1000).groupBy("file", "link_idx")
    return got.agg(F.count("pkt_idx").alias("packets"), F.sum("samples").alias("samples"), F.max("leftover").alias("leftover"))


@query(f"""
WITH {_FILES_SQL}, l({_LINK_COLUMNS}) AS (VALUES {LINKS}) SELECT file, CAST(sum(audio) AS BIGINT) AS packets, round(sum(samples) / 44100, 9) AS seconds FROM f JOIN l USING (content) GROUP BY file
""")
def ogg_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and seconds of each file, without decoding."""
    from packetloom.plans.decode import durations

    return durations(_made_up(spark, sf_dir)).select("file", "packets", F.round("seconds", 9).alias("seconds"))


@query(_LINK_SQL.format("'EndOfPacket' AS status"))
def ogg_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of links whose setup header lacks its end."""
    from packetloom.plans.decode import stream_info

    bad = _made_up(spark, sf_dir).withColumn("data", F.when(F.col("pkt_idx") == 2, F.expr("substring(data, 1, length(data) - 9)")).otherwise(F.col("data")))
    return stream_info(bad).select("file", "link_idx", "status")


@query(_LINK_SQL.format("CAST(audio AS BIGINT) AS audio, CAST(1 AS BIGINT) AS ident, CAST(1 AS BIGINT) AS comment, CAST(1 AS BIGINT) AS setup"))
def ogg_packet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each link by kind."""
    from packetloom.plans.decode import packet_kind

    kinds = ("audio", "ident", "comment", "setup")
    got = _made_up(spark, sf_dir).select("file", "link_idx", packet_kind(F.col("data")).alias("kind")).groupBy("file", "link_idx")
    return got.agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds])


@query(_LINK_SQL.format("'ok' AS status, CAST(channels AS INTEGER) AS channels, CAST(44100 AS BIGINT) AS sample_rate, 30 AS ident_bytes, true AS whole"))
def ogg_extradata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of each link from one bundle: byte 2, two lengths as runs of 255, then the packets."""
    from packetloom.plans.decode import extradata, header_packets

    lacing = lambda c: F.unhex(F.concat(F.repeat(F.lit("FF"), F.floor(F.length(c) / 255).cast("int")), F.lpad(F.hex(F.length(c) % 255), 2, "0")))
    heads = header_packets(_made_up(spark, sf_dir)).withColumn("key", F.concat_ws("|", "file", F.col("link_idx").cast("string")))
    bundles = heads.withColumn("bundle", F.concat(F.unhex(F.lit("02")), lacing(F.col("ident")), lacing(F.col("comment")), "ident", "comment", "setup"))
    got = extradata(bundles).join(bundles.select("key", "file", "link_idx", F.array(*[F.length(c) for c in ("ident", "comment", "setup")]).alias("want")), "key")
    return got.select("file", "link_idx", "status", "channels", "sample_rate", F.col("sizes")[0].alias("ident_bytes"), (F.col("sizes") == F.col("want")).alias("whole"))


_SYMBOL = "CASE WHEN ({x}) % 2 = 0 THEN 0 WHEN ({x}) // 2 % 2 = 0 THEN 1 WHEN ({x}) // 4 % 2 = 0 THEN 2 ELSE 3 END"


@query(f"""
WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS key, {_RAW} AS raw FROM lineitem), a AS (SELECT key, raw, {_SYMBOL.format(x="raw")} AS s0 FROM r), b AS (SELECT *, raw // CAST(pow(2, least(s0 + 1, 3)) AS BIGINT) AS raw1 FROM a),
c AS (SELECT *, {_SYMBOL.format(x="raw1")} AS s1 FROM b), d AS (SELECT *, raw1 // CAST(pow(2, least(s1 + 1, 3)) AS BIGINT) AS raw2 FROM c), e AS (SELECT *, {_SYMBOL.format(x="raw2")} AS s2 FROM d)
SELECT key, s0, s1, s2, least(s0 + 1, 3) + least(s1 + 1, 3) + least(s2 + 1, 3) AS bits FROM e
""")
def prefix_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three codewords of a code of lengths 1, 2, 3, 3 from the bits of each value."""
    from packetloom.plans.decode import read_symbols

    raw = F.lpad(F.hex("raw"), 8, "0")
    data = F.unhex(F.concat(*[F.substring(raw, i, 2) for i in (7, 5, 3, 1)]))
    rows = _raw(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), data.alias("data"))
    return read_symbols(rows, [1, 2, 3, 3], 3).select("key", *[F.col("symbols")[i].alias(f"s{i}") for i in range(3)], "bits")


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw, l_partkey % 32 AS skip, l_suppkey % 17 AS width FROM lineitem)
SELECT l_orderkey, l_linenumber, (raw // CAST(pow(2, skip) AS BIGINT)) % CAST(pow(2, width) AS BIGINT) AS field FROM r
""")
def dynamic_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose place and width each row names; no width: 0."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RAW).alias("raw"), "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", bits.field_of(F.col("raw"), F.col("l_partkey") % 32, F.col("l_suppkey") % 17).alias("field"))


@query("SELECT round(sum(ours), 3) AS seconds, round(sum(theirs), 3) AS other_seconds, round(sum(ours) / sum(theirs), 9) AS ratio FROM (SELECT CAST(value AS DOUBLE) AS ours, CAST(event_id % 100 + 1 AS DOUBLE) AS theirs FROM events)")
def time_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of two decoders and their ratio (here: event values against a count)."""
    times = _t(spark, sf_dir, "events").select(F.col("value").cast("double").alias("ours"), (F.col("event_id") % 100 + 1).cast("double").alias("theirs"))
    return compare.time_ratio(times, "ours", "theirs").select(
        F.round("seconds", 3).alias("seconds"), F.round("other_seconds", 3).alias("other_seconds"), F.round("ratio", 9).alias("ratio")
    )


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def integrity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose digest isn't the expected one (here: that of another text for every tenth)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    expected = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return compare.integrity(docs, F.col("text"), expected, "doc_id").select("doc_id")
