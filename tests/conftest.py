import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{at}/warehouse").config("spark.checkpoint.dir", f"{at}/checkpoints").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(columns, data):
    """Rows as sorted text, columns in name order, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(say(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def same(spark, duck, small):
    def check(query, sql):
        df = query(spark, small)
        r = duck.execute(sql)
        assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([c[0] for c in r.description], r.fetchall())

    return check
