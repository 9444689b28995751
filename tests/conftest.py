import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def compare():
    """Spark query against its SQL in DuckDB, as sorted rows with columns by name."""
    import glob
    import math

    import duckdb

    def norm(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(norm, v)) + "]"
        return str(v)

    def run(spark, query, sql, folder):
        con = duckdb.connect()
        for p in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
        df = query(spark, folder)
        cols = sorted(df.columns)
        res = con.execute(sql)
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
        got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        return got, want

    return run
