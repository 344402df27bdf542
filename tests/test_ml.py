"""The baseline model against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import ml
from corpusloom.operators import pools as P


def slow_grams(text, low=3, high=5):
    out = []
    for n in range(low, high + 1):
        for w in text.lower().split():
            w = f" {w} "
            out += [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w]
    return out


def slow_weights(texts, min_df, features):
    rows = [Counter(slow_grams(t)) for t in texts]
    df, total = Counter(g for r in rows for g in r), Counter()
    for r in rows:
        total.update(r)
    top = sorted((g for g in df if df[g] >= min_df), key=lambda g: (-total[g], g))[:features]
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in top}
    names = sorted(top)
    out = []
    for r in rows:
        w = [(1 + math.log(r[g])) * idf[g] if g in r else 0.0 for g in names]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        out.append([x / norm for x in w])
    return names, np.array(out)


def slow_regression(x, y, c, steps=60):
    """Balanced logistic regression by Newton's method; the intercept is not penalised."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    a = np.hstack([x, np.ones((n, 1))])
    theta = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1]) / c
    ridge[-1, -1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ theta))
        theta = theta - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ theta)
    return theta


def table(spark, number, seed):
    rnd = random.Random(seed)
    rows = [(k, " ".join(rnd.choice(["ls", "cat", "Été", "x", "grep -r", f"f{rnd.randrange(9)}", "nc -e" if k % 3 == 0 else "pwd"]) for _ in range(rnd.randint(1, 7))), int(k % 3 == 0), rnd.choice("stuv")) for k in range(number)]
    return rows, spark.createDataFrame(rows, "k long, command string, label int, source string")


def test_term_weights(spark):
    rows, df = table(spark, 60, 1)
    model = ml.Baseline(min_df=2, features=40)
    numbered = ml._numbered(df)
    got = {r["k"]: r["f"] for r in model._vectors(numbered)(numbered).select("k", vector_to_array("features").alias("f")).collect()}
    names, want = slow_weights([r[1] for r in rows], 2, 40)
    assert len(names) == 40
    assert np.allclose(np.array([got[r[0]] for r in rows]), want)


def test_probabilities(spark):
    rows, df = table(spark, 90, 2)
    score = ml.Baseline(min_df=2, features=25).fit(df)
    got = {r["k"]: r["score"] for r in score(df).collect()}
    _, x = slow_weights([r[1] for r in rows], 2, 25)
    y = np.array([r[2] for r in rows])
    theta = slow_regression(x, y, 4.0)
    want = 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(y), 1))]) @ theta)))
    assert max(abs(got[r[0]] - p) for r, p in zip(rows, want)) < 0.02


def test_fit_without_is_a_fit_from_scratch(spark):
    _, df = table(spark, 80, 3)
    train, test = df.where("k < 60"), df.where("k >= 60")
    scores = lambda t: {r["k"]: r["score"] for r in t.collect()}
    got = ml.Baseline(min_df=2, features=30).fit_without(train, test, "source", ["s", "t"], 2, scores)
    for name in "st":
        fresh = scores(ml.Baseline(min_df=2, features=30).fit(train.where(F.col("source") != name))(test.where(F.col("source") == name)))
        assert got[name].keys() == fresh.keys() and fresh
        assert all(abs(got[name][k] - fresh[k]) < 1e-3 for k in fresh)


def test_length_model(spark):
    rows = [("a" * n, int(n > 20)) for n in range(1, 41)] + [("a" * 30, 0), ("a" * 10, 1)]
    df = spark.createDataFrame(rows, "command string, label int")
    got = ml.length_model(df)(df).orderBy(F.length("command")).select("score").collect()
    values = [r["score"] for r in got]
    assert values == sorted(values) and values[0] < 0.5 < values[-1]


def test_areas_over_distinct_scores(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.random() if rnd.random() < 0.8 else 0.5, int(rnd.random() < 0.3)) for g in "ab" for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        area = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        assert abs(S.roc_auc(df, "label", "score", ["g"]).where(F.col("g") == g).first()["roc_auc"] - area) < 1e-9
        precision, tp, seen = 0.0, 0, 0
        for s in sorted({s for s, _ in own}, reverse=True):
            at = [y for x, y in own if x == s]
            tp, seen = tp + sum(at), seen + len(at)
            precision += sum(at) * tp / seen
        assert abs(S.average_precision(df, "label", "score", ["g"]).where(F.col("g") == g).first()["pr_auc"] - precision / len(pos)) < 1e-9


@pytest.mark.parametrize("few", [100_000, 40])
def test_group_split_by_stretches(spark, few):
    rnd = random.Random(7)
    rows = [(d, y, f"{d}{y}{g}", f"c{g}") for d in (1, 2) for y in (0, 1) for g in range(300) for _ in range(rnd.choice([1, 1, 2, 9, 60]) if y else 1)]
    df = spark.createDataFrame(rows, "dataset int, label int, shape string, command string")
    got = {(r["dataset"], r["label"], r["shape"]): r["split"] for r in P.group_split(df, few=few).collect()}
    order = {r["shape"]: r["h"] for r in df.select("shape", P.scoped_hash("split", "shape").alias("h")).distinct().collect()}
    for d in (1, 2):
        for y in (0, 1):
            sizes = Counter(r[2] for r in rows if r[:2] == (d, y))
            room = round(sum(sizes.values()) * (1 - 0.8))
            for shape in sorted(sizes, key=lambda s: (order[s], s)):
                fits = sizes[shape] <= room
                room -= sizes[shape] if fits else 0
                assert got[d, y, shape] == ("test" if fits else "train")
