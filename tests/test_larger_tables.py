"""Queries against their SQL on tables that differ from the test tables in what grows with them."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from orbitile.plans.registry import ORACLE_SQL, QUERIES

from .test_oracle import rows_of


def both(spark, name, folder):
    """Rows of a query, and of its SQL, over the tables in a folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    found, got = con.execute(ORACLE_SQL[name]), QUERIES[name](spark, str(folder))
    return rows_of(got.columns, map(tuple, got.collect())), rows_of([d[0] for d in found.description], found.fetchall())


@pytest.fixture
def many_events(spark, tmp_path):
    """One group beyond 2,000 events, one of the same time throughout, small ones, one without a time, and rows without a group."""
    start, sizes = datetime(2024, 1, 1), {0: 2100, 1: 2050, 2: 40, 3: 7, 4: 1, 5: 3, None: 5}
    rows = []
    for user, n in sizes.items():
        for i in range(n):
            rows.append((None if user == 5 else start + timedelta(seconds=0 if user == 1 else 977 * i, milliseconds=i % 1000), user))
    rows += [(None, 2)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    return tmp_path


def test_groups_beyond_the_total(spark, many_events):
    have, want = both(spark, "streamed_throughput", many_events)
    assert have == want
    assert len(have) == 7 and any(r[2] is not None and r[2] < 0 for r in have)


@pytest.fixture
def repeated_lines(spark, tmp_path):
    """Lines that occur twice, lines whose pixels get one number, lines without a number, and a part that occurs twice."""
    shipped = datetime(1995, 1, 2)
    lines = [
        (k, 7, p, 3, float(k), 1000.5 * k, 0.04 * (k % 3), 0.02, shipped)
        for k, n in ((1, 1), (2, 2), (3, 3), (4, 1)) for p in (9, 14, 25) for _ in range(n)
    ]
    # 100,000 parts on and a line back: the number of the line above it, with other values
    lines += [(1, 6, 100_009, 3, 1.0, 77.0, 0.08, 0.06, shipped), (1, 6, 100_014, 3, 1.0, 1000.5, 0.04, 0.02, shipped)]
    lines += [(None, 1, 9, 3, 5.0, 10.0, 0.0, 0.0, shipped), (None, 2, 9, 3, 5.0, None, None, 0.01, shipped)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(9, 5), (14, 17), (25, 30), (25, 31), (100_009, 44)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return tmp_path


def test_pixels_of_one_number(spark, repeated_lines):
    have, want = both(spark, "bands_from_files", repeated_lines)
    assert have == want
    numbers = [r[-1] for r in have]  # columns are in order of their names
    assert len(set(numbers)) < len(numbers)
