"""Incremental ingest over files that arrive in turn."""

import datetime as dt

from corpusloom.streaming.ingest import ingested, write_pool


def test_ingest(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "raw string, ts timestamp"
    at = dt.datetime(2024, 1, 1)
    for k, texts in enumerate([["ls  -l", "ls -l", "# no", None], ["ls -l", "pwd", "'open"]]):
        spark.createDataFrame([(t, at) for t in texts], schema).write.mode("append").parquet(src)
        write_pool(ingested(spark.readStream.schema(schema).parquet(src)), out, state).awaitTermination()
        assert sorted(r["command"] for r in spark.read.parquet(out).collect()) == [["ls -l"], ["ls -l", "pwd"]][k]
