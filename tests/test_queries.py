"""Every query of the suite against its SQL, on the smallest tables."""

import duckdb
import pytest

import ledgerline.plans.ops_queries  # noqa: F401  these register their queries
import ledgerline.plans.write_queries  # noqa: F401
import ledgerline.streaming.queries  # noqa: F401
from ledgerline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"ycsb_oplog", "bloom_probe"}


def test_bloom_filter(spark):
    got = QUERIES["bloom_probe"](spark, SF).collect()
    assert all(r.maybe for r in got if r.key.startswith("user:"))
    assert sum(r.maybe for r in got if r.key.startswith("absent:")) < 0.05 * 2000


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_counter_rate_rounds_as_its_sql(spark, tmp_path):
    # rates whose ninth decimal hangs on how they are rounded, some over 2^53 / 1e9; the last rows tie in time
    gaps = [(403, 151), (571, 127), (613, 185), (976, 269), (613, 174), (787, 1116), (553, 67), (924, 3482), (999, 1), (7, 30_000_000)]
    events, at = [], 0
    for i, (value, gap) in enumerate(gaps):
        events += [(2000 * i, at + 1), (2000 * i + value, at + 1 + gap)]
        at += 1 + gap
    events += [(1_000_000 * k + value, at) for k, value in ((1, 7), (2, 7))]
    source = ", ".join(f"({i}, {t})" for i, t in events)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, make_timestamp(t::BIGINT) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM (VALUES {source}) r(i, t)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["counter_rate"](spark, str(tmp_path))
    want = con.execute(ORACLES["counter_rate"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())
