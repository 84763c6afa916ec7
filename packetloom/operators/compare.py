"""Comparison of decoded streams, integrity and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance_diff(a: DataFrame, b: DataFrame, keys: list[str], at: str, value: str, packet: str, tolerance: float) -> DataFrame:
    """keys, packets, differing, percent, extra: packets of a with a sample that b lacks or has farther off than the tolerance, and the samples that only b has."""
    mine = a.select(*keys, at, packet, F.col(value).alias("_value"), F.lit(True).alias("_mine"))
    joined = mine.join(b.select(*keys, at, F.col(value).alias("_other")), [*keys, at], "full")
    far = F.col("_other").isNull() | (F.abs(F.col("_value") - F.col("_other")) > tolerance)
    each = joined.groupBy(*keys, packet).agg(F.max(F.when(F.col("_mine"), far.cast("int"))).alias("_far"), F.sum(F.col("_mine").isNull().cast("long")).alias("_extra"))
    return each.groupBy(*keys).agg(F.count("_far").alias("packets"), F.sum("_far").alias("differing"), (F.avg("_far") * 100).alias("percent"), F.sum("_extra").alias("extra"))


def integrity(df: DataFrame, content: Column, expected: DataFrame, key: str) -> DataFrame:
    """Rows whose sha256 isn't that of expected (key, digest)."""
    return df.withColumn("_digest", F.sha2(content, 256)).join(expected.withColumnRenamed("digest", "_digest"), [key, "_digest"], "left_anti").drop("_digest")


def status_check(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows of df (key, status) whose status isn't that of expected (key, expected_status)."""
    return df.join(expected, key).filter(~F.col("status").eqNullSafe(F.col("expected_status")))


def duration(samples: DataFrame, keys: list[str], count: Column, rate: Column) -> DataFrame:
    """keys, packets and seconds."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), (F.sum(count) / F.first(rate)).alias("seconds"))


def time_ratio(times: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Total seconds of two decoders, and their ratio."""
    return times.agg(F.sum(ours).alias("seconds"), F.sum(theirs).alias("other_seconds"), (F.sum(ours) / F.sum(theirs)).alias("ratio"))
