"""Every query that has SQL gives the rows DuckDB gives on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tokenloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{float(value):.9g}" if isinstance(value, (float, decimal.Decimal)) else str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    want = sorted(tuple(plain(r[theirs.index(n)]) for n in names) for r in result.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


def test_entry(spark):
    assert {r.event_type for r in entry.entry(spark).collect()}


def test_streams_of_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, '{"k": 1}'), (2, None), (3, ""), (4, "[1,"), (5, "12345678")], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    rows = {r.stream_id: tuple(r)[1:] for r in queries.queries()["streamed_chunks"](spark, str(tmp_path)).collect()}
    assert rows == {"1": (7, 0, 8), "2": (1, 1, 0), "3": (1, 1, 0), "4": (4, 1, 3), "5": (2, 0, 8)}


def test_member_values_of_repeated_orders(spark, duck, tmp_path):
    """Each text is counted by itself, as in the SQL, and nothing is grouped over a task's texts."""
    o = spark.read.parquet(f"{SF}/orders.parquet").limit(20)
    o.union(o.limit(3)).write.parquet(str(tmp_path / "orders.parquet"))
    df = queries.queries()["member_values"](spark, str(tmp_path))
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    sql = queries.oracle_sql()["member_values"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet' o")
    want = sorted(tuple(map(plain, r)) for r in duck.execute(sql).fetchall())
    assert len(want) == 115 and sorted(tuple(map(plain, (r.id, r.name, r.depth, r.n))) for r in df.collect()) == want


@pytest.mark.parametrize(("name", "table"), [("pointer_array_index", "orders"), ("jsonl_split", "events"), ("json_sequence_files", "events"), ("whole_files", "events")])
def test_values_side_by_side_of_repeated_rows(spark, duck, tmp_path, name, table):
    """A row per text, as in the SQL, without grouping by text."""
    rows = spark.read.parquet(f"{SF}/{table}.parquet").limit(20)
    rows.union(rows.limit(3)).write.parquet(str(tmp_path / f"{table}.parquet"))
    df = queries.queries()[name](spark, str(tmp_path))
    result = duck.execute(queries.oracle_sql()[name].replace(f"FROM {table}", f"FROM '{tmp_path}/{table}.parquet/*.parquet' o"))
    columns = [d[0] for d in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert len(want) == 23 and sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
