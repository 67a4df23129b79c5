import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from voicegrid.session import local_session, ship

    session = ship(local_session(4, 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def compared(spark, duck, name, sf_dir=SF):
    """Rows of the query and of its SQL that the other hasn't."""
    import __spark_entry__ as entry

    mine = entry.queries()[name](spark, sf_dir).toPandas()
    duck.register("mine", mine)
    columns = ", ".join(f'"{c}"' for c in sorted(mine.columns))
    theirs = entry.oracle_sql()[name]
    duck.sql(f"create or replace temp table theirs as {theirs}")
    assert sorted(mine.columns) == sorted(r[0] for r in duck.sql("describe theirs").fetchall())
    return [duck.sql(f"select count(*) from (select {columns} from {a} except all select {columns} from {b})").fetchall()[0][0] for a, b in (("mine", "theirs"), ("theirs", "mine"))]


@pytest.fixture(scope="session")
def compare(spark, duck):
    return lambda name: compared(spark, duck, name)
