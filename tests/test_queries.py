"""Every registered query with SQL gives DuckDB's rows; the rest run."""

import duckdb
import pytest

from packetloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(map(str, frame[cols].astype(object).values.tolist())), cols


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, sf).toPandas()) == rows_of(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_optional_parts(monkeypatch):
    """The engine's own queries stay when the training-data folder, or a library that it needs, is missing."""
    import sys

    import __spark_entry__

    own = set(queries.QUERIES)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == own and set(__spark_entry__.oracle_sql()) == set(queries.ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    for name in [m for m in sys.modules if m.startswith("packetloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    try:
        import packetloom.llm  # noqa: F401
    except ImportError:
        return
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) == own


def test_lines_take_little_room(spark, tmp_path):
    """Of the many rows of lines, positions are stored as repeats, not as 8 bytes each; equal positions give no row."""
    from pyspark.sql import functions as F

    every = spark.range(20_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 200).alias("user_id"), (F.col("id") * 7919 % 100 / 2).alias("value")
    ).union(spark.sql("SELECT 0L, 0L, 0D"))  # the first event twice
    every.write.parquet(str(tmp_path / "events.parquet"))
    queries.QUERIES["render_line"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    sizes = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT count(*), sum(user_id * 31 + x * 7 + y) FROM ({queries.ORACLE_SQL['render_line']})").fetchone()
    assert tuple(map(int, want)) == tuple(got.agg(F.count("*"), F.sum(F.expr("user_id * 31 + x * 7 + y"))).first())
    assert sizes < 2 * got.count()
