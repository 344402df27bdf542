"""Grams of the baseline counted where the rows lie; rows of the pool and cuts of a deal kept small."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ml
from corpusloom.operators import pools as P
from corpusloom.plans import base
from tests.test_ml import slow_grams

ODD = [None, "", " ", "a", "Ab \U0001f600c  d e", "İstanbul ΣΑΣ", "x" * 40]


@pytest.mark.parametrize("few", [False, True])
def test_grams_are_counted_in_the_tasks(spark, monkeypatch, few):
    if few:  # chunks of few rows, and counts that are sent several times
        for name, most in (("CHUNK", 20), ("WORDS", 3), ("GRAMS", 10)):
            monkeypatch.setattr(ml, name, most)
    rnd = random.Random(11)
    rows = [(i, x, rnd.choice(["s", "t", None])) for i, x in enumerate([*ODD, *[" ".join(rnd.choice(["ls", "-la", "Été", "grep"]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]])]
    df = spark.createDataFrame(rows, "k long, command string, source string")
    lowered = {r["k"]: r["x"] for r in df.selectExpr("k", "lower(command) AS x").collect()}
    own = {i: Counter(slow_grams(lowered[i] or "")) for i, _, _ in rows}
    want = {}
    for i, _, s in rows:
        for g, n in own[i].items():
            d, t = want.get((s, g), (0, 0))
            want[s, g] = d + 1, t + n
    model = ml.Baseline()
    got = {(r["_name"], r["gram"]): (r["df"], r["total"]) for r in model._counts(df, "source").collect()}
    assert got == want
    every = {r["gram"]: (r["df"], r["total"]) for r in model._counts(df).collect()}
    assert every == {g: tuple(map(sum, zip(*[v for (_, h), v in want.items() if h == g]))) for g in {g for _, g in want}}
    grams = sorted(every)[::2]
    terms = model._terms(df, pa.array(grams))
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    for r in terms.collect():
        assert dict(zip([grams[i] for i in r["_ids"]], r["_tf"])) == {g: n for g, n in own[r["k"]].items() if g in grams}
        assert r["_ids"] == sorted(r["_ids"])


def test_a_shaped_row_holds_its_line_once(spark, tmp_path):
    texts = ["ls -l /tmp\nls\x1b[0m -a\necho hi", "cat x\x07y\n‘a b’ c\n^C", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shaped = base.shaped(spark, str(tmp_path))
    assert not {"raw", "violations"} & set(shaped.columns)
    want = base.pool(spark, str(tmp_path)).where("size(violations) = 0").select("doc_id", "pos", "command")
    assert sorted(shaped.select("doc_id", "pos", "command").collect()) == sorted(want.collect())
    assert {r["command"] for r in shaped.collect()} == {"ls -l /tmp", "echo hi", "'a b' c"}


def test_a_cut_ranks_few_rows_of_a_task(spark):
    rows = [(s, f"{s}{k}", f"c{k}{i}") for s in "ab" for k in range(40) for i in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "source string, shape string, command string")
    dealt = P.deal(df, ["source"], "shape", "command", "take", most=50)
    assert "WindowGroupLimit" in dealt._jdf.queryExecution().optimizedPlan().toString()
    quota = df.select("source").distinct().withColumn("_quota", F.lit(50))
    whole = P.cut_rounds(P.deal(df, ["source"], "shape", "command", "take"), quota, ["source"], "shape", "take")
    key = lambda t: sorted((r["source"], r["command"], r["round"]) for r in t.collect())
    assert key(dealt) == key(whole) and len(key(dealt)) == 100
