"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []  # written tables, in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a plain local master, where one process does all the work, may do without that setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder of this machine", stacklevel=3)
        _local[app] = "file://" + tempfile.mkdtemp(prefix="packetloom-")
    return _local[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that outlives lost executors.

    Tables go when drop_tables is called, and when Python ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def tables_made() -> int:
    """Number of tables written so far, for drop_tables."""
    return len(_made)


def drop_tables(since: int, *keep: DataFrame) -> None:
    """Removes the tables written since then, but for those that materialize gave as keep. What still has to be computed from others is lost."""
    stay = {df._table_path for df in keep}
    for spark, path in [t for t in _made[since:] if t[1] not in stay]:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended before Python does
            continue
    _made[since:] = [t for t in _made[since:] if t[1] in stay]


atexit.register(drop_tables, 0)


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % n


def byte_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about limit bytes of text at most (or one row): Python objects take many times the bytes of a batch."""
    for b in batches:
        if b.nbytes <= limit:
            if b.num_rows:
                yield b
            continue
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        group = np.maximum.accumulate((np.cumsum(size) - 1) // limit)
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield b.slice(lo, hi - lo)


def sampled(key: Column, share: Column | float) -> Column:
    """Does a hash (62 bits of it) put a row into a sample of this share; a share of 1 takes all."""
    part = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 2)
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return part.cast("double") < share * float(1 << 62)


def arrow_map(fn: Callable[[dict[str, list]], dict[str, list]], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function that hands fn lists by column and takes lists by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            got = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
