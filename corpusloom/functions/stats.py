"""Scores, floors and intervals as column expressions and small aggregations.

Every F1 comes with its prevalence p and the do-nothing floor 2p/(1+p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions.ranks import running
from corpusloom.session import stored


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = DEFAULT.z95) -> tuple[Column, Column]:
    """The Wilson interval of k of n: (0, 1) for none, closed at the ends where k is 0 or n."""
    p, n_ = ratio(k, n), n.cast("double")
    scale = 1 + F.lit(z * z) / F.nullif(n_, F.lit(0.0))
    middle = (p + F.lit(z * z) / (2 * F.nullif(n_, F.lit(0.0)))) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n_, F.lit(0.0)) + F.lit(z * z) / (4 * F.nullif(n_ * n_, F.lit(0.0)))) / scale
    lo = F.when((n == 0) | (k == 0), 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    hi = F.when((n == 0) | (k == n), 1.0).otherwise(F.least(F.lit(1.0), middle + half))
    return lo, hi


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def do_nothing_f1(p: Column) -> Column:
    return 2 * p / (1 + p)


def macro_floor(q: Column, k: Column) -> Column:
    """The macro-F1 of always naming the largest of k classes, with share q."""
    return 2 * q / (1 + q) / k


def headroom(value: Column, floor: Column) -> Column:
    """(value - floor) / (1 - floor), null where nothing is left above the floor."""
    return F.when(F.abs(1 - floor) < 1e-12, F.lit(None)).otherwise((value - floor) / F.nullif(1 - floor, F.lit(0.0)))


def score_row(df: DataFrame, label: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """n, n_pos, p, floor, precision, recall, f1, f1_minus_floor and f1_norm of a prediction, per group."""
    y = F.col(label) == 1
    hit = lambda c: F.count_if(c).cast("double")
    counts = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(y).alias("n_pos"), hit(y & positive).alias("tp"), hit(~y & positive).alias("fp"), hit(y & ~positive).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = counts.withColumns({"p": ratio(F.col("n_pos"), F.col("n")), "precision": zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))), "f1": zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))})
    counts = counts.withColumn("floor", do_nothing_f1(F.col("p")))
    return counts.withColumns({"f1_minus_floor": F.col("f1") - F.col("floor"), "f1_norm": headroom(F.col("f1"), F.col("floor"))}).drop("tp", "fp", "fn")


def make_row(df: DataFrame, label: str, score: str | None = None, prediction: str | None = None, threshold: float = DEFAULT.threshold) -> DataFrame:
    """The one-row score of either a score (strictly above the threshold) or a prediction."""
    if (score is None) == (prediction is None):
        raise ValueError("give exactly one of score and prediction")
    if prediction is not None:
        return score_row(df, label, F.col(prediction) == 1)
    row = score_row(df, label, F.col(score) > threshold)
    return row.crossJoin(roc_auc(df, label, score)).crossJoin(average_precision(df, label, score))  # one row each


def _by_score(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    return stored(df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")), "by_score")


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by half; null with a single class. Distinct scores are ranked in ranges."""
    by = by or []
    t = running(_by_score(df, label, score, by), by, F.col(score), [F.col(score)], below=F.col("neg"))
    area = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    return t.groupBy(*by).agg(ratio(area, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The step sum of precision over recall (not the trapezoid), with the prevalence as its baseline."""
    by = by or []
    t = running(_by_score(df, label, score, by), by, -F.col(score), [F.col(score).desc()], tp=F.col("pos"), seen=F.col("pos") + F.col("neg"))
    t = t.withColumns({"tp": F.col("tp") + F.col("pos"), "seen": F.col("seen") + F.col("pos") + F.col("neg")})
    total = F.sum("pos").cast("double")
    return t.groupBy(*by).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), total).alias("pr_auc"), ratio(total, F.sum(F.col("pos") + F.col("neg"))).alias("pr_auc_base"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, tp, recall and f1 of every class named by either column."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("b")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("b").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("tp")))))
    t = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp"))
    return t.select("class", "support", "tp", F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"), F.coalesce(ratio(2.0 * F.col("tp"), F.col("support") + F.col("guessed")), F.lit(0.0)).alias("f1"))


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Macro-F1 with the number of classes, the largest class's share, and the floor."""
    t = per_class(df, actual, predicted).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("k"), ratio(F.max("support"), F.sum("support")).alias("q"))
    t = t.withColumn("floor", macro_floor(F.col("q"), F.col("k")))
    return t.withColumn("norm", headroom(F.col("macro_f1"), F.col("floor")))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """The confusion matrix with a column per label, in the given order."""
    return df.groupBy(actual).pivot(predicted, labels).count().na.fill(0)
