"""Lengths against their SQL, on counts of every remainder; what a pool computes once."""

import time

import duckdb

from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.functions import text as T
from corpusloom.session import CLEANUP, stored
from corpusloom.sources import readers


def test_length_quantiles_of_every_count_are_the_sql_s(spark, tmp_path):
    rows = [(f"s{n}", "x" * (7 * i % 11), i) for n in range(1, 14) for i in range(n)]
    rows += [("nulls", None if i % 3 else "y" * i, i) for i in range(9)] + [("lone", None, 0), (None, "z", 1), (None, "zz", 2)]
    spark.createDataFrame(rows, "source string, text string, doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["q_length_quantiles"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(plans.ORACLE["q_length_quantiles"])
    names = [c[0] for c in found.description]
    wanted = [tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_pool_normalises_once(spark):
    rows = spark.createDataFrame([("a b http://x.y/z", 0, "p")], "raw string, pos int, path string")
    mentions = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(T.URL_HOST)
    assert mentions(readers.pooled(rows)) <= mentions(rows.select(T.normalize(F.col("raw"))))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    shuffles = lambda: {x for x in files().split() if "/shuffle_" in x}
    before, own = shuffles(), spark.conf.get(CLEANUP, "false")
    stored(spark.range(1000).repartition(3, "id"), "few")
    for _ in range(50):  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(CLEANUP, "false") == own
