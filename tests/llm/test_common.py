"""Helpers of the training-data operators."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import _common


@pytest.mark.parametrize("limit", [1, 10, 100, 10_000])
def test_byte_slices_keep_rows_in_order(limit):
    rng = random.Random(limit)
    texts = [None if rng.random() < 0.1 else "é" * rng.randrange(0, 60) for _ in range(200)] + ["x" * 5000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    parts = list(_common.byte_slices([batch, batch.slice(0, 0)], limit))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(len(texts))) and all(p.num_rows for p in parts)
    for p in parts:
        sizes = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert sum(sizes[1:]) <= limit  # beside the first row


def test_samples_have_their_share(spark):
    ids = spark.range(20_000)
    assert ids.filter(_common.sampled(F.col("id"), 1.0)).count() == 20_000 and ids.filter(_common.sampled(F.col("id"), 0.0)).count() == 0
    assert abs(ids.filter(_common.sampled(F.col("id"), 0.1)).count() - 2000) < 200


def test_tables_are_dropped(spark):
    since = _common.tables_made()
    a, b = (_common.materialize(spark.range(3), "test").withColumnRenamed("id", n) for n in ("a", "b"))
    kept = _common.materialize(a.union(b), "test")
    paths = [p.removeprefix("file://") for _, p in _common._made[since:]]
    assert all(map(os.path.isdir, paths))
    _common.drop_tables(since, kept)
    assert [os.path.isdir(p) for p in paths] == [False, False, True] and kept.count() == 6
    _common.drop_tables(since)
    assert not os.path.isdir(paths[2]) and _common.tables_made() == since
