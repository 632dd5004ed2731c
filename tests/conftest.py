import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    clean = lambda x: 0.0 if isinstance(x, float) and x == 0 else x
    key = lambda r: tuple((x is None, 0 if x is None else round(x, 7) if isinstance(x, float) else x) for x in r)
    return sorted((tuple(clean(r[k]) for k in at) for r in rows), key=key)


def same_rows(df, con, sql):
    """Whether a DataFrame and a query give the same rows, in any order."""
    got = df.collect()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    return rows_of(df.columns, [tuple(r) for r in got], df.columns) == rows_of(columns, cur.fetchall(), df.columns)
