"""Functions on columns for header data: comments and trees of codewords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_entry(entry: Column, separator: str = "=") -> tuple[Column, Column]:
    """Key and value of a comment, split at the first separator; nulls for an entry without one."""
    at = F.instr(entry, separator)
    return F.when(at > 0, F.substring(entry, F.lit(1), at - 1)), F.when(at > 0, F.substr(entry, at + 1))


def tree_status(lengths: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """keys, n, kraft, status of each codebook, from a row for each used codeword: Overspecified, Underpopulated, InvalidSingleEntry or ok."""
    g = lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.lit(2.0), -length.cast("double"))).alias("kraft"), F.min(length).alias("least"))
    single = F.when(F.col("least") == 1, "ok").otherwise("InvalidSingleEntry")
    status = F.when(F.col("n") == 1, single).when(F.col("kraft") > 1, "Overspecified").when(F.col("kraft") < 1, "Underpopulated").otherwise("ok")
    return g.select(*keys, "n", "kraft", status.alias("status"))


def look_up(entries: DataFrame, book: DataFrame, entry: str, key: str, vector: str) -> DataFrame:
    """entries with the vector of their number; null for numbers that the book (a dictionary, of few rows) doesn't map."""
    return entries.join(book.select(F.col(key).alias("_key"), vector), F.col(entry) == F.col("_key"), "left").drop("_key")
