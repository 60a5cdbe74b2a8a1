"""Queries and their SQL on tables where only the rule as it is written gives the right rows."""

import pytest

from strandline.plans import registry

KEYS, PLACES, TIMES = 3, 1000, 6


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Line items and events whose segments lie apart, each of them there six times."""
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path_factory.mktemp("repeated")
    rows = f"FROM range({TIMES}) c(c), range({PLACES}) p(p), range({KEYS}) k(k)"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS l_orderkey, 10.0::DOUBLE * (p * 7919 % {PLACES}) AS l_quantity, 1::INT AS l_linenumber {rows}) TO '{path}/lineitem.parquet'")
    # Places 0, 50, 100 ... of 100,000.
    con.execute(f"COPY (SELECT c * 100000 + p * 50 * {pow(7919, -1, 100_000)} % 100000 AS event_id, k AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value {rows}) TO '{path}/events.parquet'")
    return str(path)


def both(spark, tables, name):
    """Sorted rows of the query, and of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tables}/{t}.parquet')")
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, tables).collect()), sorted(con.execute(registry.ORACLE[name]).fetchall())


def test_complement_intervals(spark, tables):
    want = [(k, 10 * p + 4, 10 * p + 9) for k in range(KEYS) for p in range(PLACES - 1)]
    assert both(spark, tables, "complement_intervals") == (want, want)


def test_covered_length(spark, tables):
    want = [(k, 4 * PLACES) for k in range(KEYS)]
    assert both(spark, tables, "covered_length") == (want, want)


def test_merge_intervals(spark, tables):
    want = [(k, 10 * p, 10 * p + 3) for k in range(KEYS) for p in range(PLACES)]
    assert both(spark, tables, "merge_intervals") == (want, want)


def test_merge_intervals_by_bins(spark, tables):
    want = [(k, 10 * p, 10 * p + 3) for k in range(KEYS) for p in range(PLACES)]
    assert both(spark, tables, "merge_intervals_by_bins") == (want, want)


def test_snv_blocks(spark, tables):
    want = [(k, p + 1, 50 * p, 50 * p + 40, TIMES) for k in range(KEYS) for p in range(PLACES)]
    assert both(spark, tables, "snv_blocks") == (want, want)


def test_moving_window_profile(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # Three values at each of two places, the first one and 99,990 of 100,000.
    last = 99_990 * pow(7919, -1, 100_000) % 100_000
    duckdb.connect().execute(f"COPY (SELECT c * 100000 + x AS event_id, 7::BIGINT AS user_id, 'view' AS event_type, c * 1.5::DOUBLE AS value FROM range(3) c(c), (VALUES (0), ({last})) v(x)) TO '{tmp_path}/events.parquet'")
    duckdb.connect().execute(f"COPY (SELECT 1 AS l_orderkey) TO '{tmp_path}/lineitem.parquet'")
    want = [(7, 100 * c, 3, 1.5) for c in (0, 1, 2, 998, 999, 1000, 1001, 1002)]
    assert both(spark, str(tmp_path), "moving_window_profile") == (want, want)
