import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    rows = sorted(repr([norm(x) for x in r]) for r in got.select(columns).collect())
    assert rows == sorted(repr([norm(x) for x in r]) for r in want.select(*columns).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def test_windowed_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera import adapters
    from tessera.streaming.review import read_requirements, windowed_scores

    adapters.requirements(spark, DATA).withColumn("arrived", F.timestamp_seconds(F.col("ordinal") * 60)).write.parquet(str(tmp_path / "in"))
    q = windowed_scores(read_requirements(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(total) from scores").first()[0] == 1000
