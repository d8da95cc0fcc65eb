import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from umbra.session import session

    s = session(
        "local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false",
        spark_driver_memory="4g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
        spark_checkpoint_dir="file://" + str(tmp_path_factory.mktemp("checkpoint")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(duck):
    def check(df, sql):
        cur = duck.execute(sql)
        want = canonical(cur.fetchall(), [d[0] for d in cur.description])
        assert canonical([tuple(r) for r in df.collect()], df.columns) == want

    return check
