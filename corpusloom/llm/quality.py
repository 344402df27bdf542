"""Quality rules with thresholds that adapt to language and source.

Only DataFrame functions. Per document: counts of words, characters, symbols,
repeated lines and repeated three-word windows. The counts give four ratios; each
ratio goes into a log-bucket quantile sketch (bucket counts with a fixed relative
error), which merges by addition, per language and source. Fences from the sketch's
quartiles replace fixed cutoffs, and a join with them decides.

Null text has no words. Null languages and sources are groups of their own. Equal
rows get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, settled, small, words, wrapped
from corpusloom.session import stored

#: Relative width of a sketch bucket.
GAMMA = 1.02
#: Bucket of the value zero, below every other.
ZERO = -100_000
#: A group of fewer documents takes the sketch of its language, then of all documents.
MIN_GROUP = 200
#: Quartile spreads beyond the upper (lower) quartile that a ratio may lie.
REACH = 6.0
#: ratio: (numerator, denominator, least spread, whether low values count too).
RATIOS = {
    "word_length": ("word_chars", "n_words", 0.25, True),
    "symbols": ("n_symbols", "n_words", 0.02, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.06, False),
    "repeats": ("n_repeat_words", "n_words", 0.05, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, n_lines (lines with a word) and base_failed, under the prefix ``q_``."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = settled(df, _w=words(F.col(text)))
    n = F.size("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = settled(df, _h=F.when(n > 2, window).otherwise(F.array().cast("array<bigint>")), _l=lines)
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = settled(df, _s=F.when(twice, pairs))
    repeated = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(x["h"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    out = settled(
        df,
        q_n_words=n.cast("long"),
        q_word_chars=F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        q_n_symbols=F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        q_n_lines=F.size("_l").cast("long"),
        q_n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        q_n_repeat_words=F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    ).drop("_w", "_h", "_l", "_s")
    return out.withColumn("q_base_failed", (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50))


def _ratio(name: str) -> Column:
    over, under, _, _ = RATIOS[name]
    return F.when(F.col(f"q_{under}") > 0, F.col(f"q_{over}") / F.col(f"q_{under}")).otherwise(F.lit(0.0))


def _bucket(v: Column) -> Column:
    return F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / F.log(F.lit(GAMMA)))).cast("int")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts of every ratio per language and source: mergeable by adding n."""
    ratios = F.array(*[F.struct(F.lit(m).alias("ratio"), _bucket(_ratio(m)).alias("bucket")) for m in RATIOS])
    return measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(ratios)).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with ``<ratio>_lo`` and ``<ratio>_hi``.

    Groups below ``min_group`` documents use the merged sketch of their language, and
    that one, if too small as well, the merge of all.
    """

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        by = [*keys, "ratio"]
        w = Window.partitionBy(*by).orderBy("bucket")
        s = s.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*by))})
        value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
        at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(q * F.col("total")), value))
        return s.groupBy(*by).agg(F.max("total").alias("total"), at(F.lit(0.25)).alias("q1"), at(F.lit(0.75)).alias("q3"))

    def merged(keys: list[str]) -> DataFrame:
        return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))

    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(merged(["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("lr"), F.struct("total", "q1", "q3").alias("by_lang"))
    every = quartiles(merged([]), []).select(F.col("ratio").alias("er"), F.struct("total", "q1", "q3").alias("by_all"))
    best = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("lr"))).join(every, F.col("ratio") == F.col("er"))
    pick = F.when(F.col("total") >= min_group, F.struct("total", "q1", "q3")).when(F.col("by_lang.total") >= min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    best = best.select("lang", "source", "ratio", pick.alias("p"))
    bounds = []
    for m, (_, _, least, low) in RATIOS.items():
        spread = F.greatest(F.col("p.q3") - F.col("p.q1"), F.lit(least)) * reach
        bounds.append(F.max(F.when(F.col("ratio") == m, F.col("p.q3") + spread)).alias(f"{m}_hi"))
        bounds.append(F.max(F.when(F.col("ratio") == m, F.col("p.q1") - spread if low else F.lit(-1.0))).alias(f"{m}_lo"))
    return best.groupBy("lang", "source").agg(*bounds)


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with boolean ``kept``: not base_failed and every ratio within its fences."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(f"{m}_{e}").alias(f"_{m}_{e}") for m in RATIOS for e in ("lo", "hi")])
    inside = F.lit(True)
    for m in RATIOS:
        inside = inside & _ratio(m).between(F.col(f"_{m}_lo"), F.col(f"_{m}_hi"))
    same = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    out = measured.join(limits, same, "left").withColumn("kept", ~F.col("q_base_failed") & F.coalesce(inside, F.lit(False)))
    return out.drop(*limits.columns)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, base_failed and kept per document; the counts are written once and judged from the table."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = stored(with_counts(narrow).drop("text"), "quality")
    out = judged(measured, small(stored(fences(sketches(measured)), "fences")))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_base_failed").alias("base_failed"), "kept")


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = wrapped(docs, text=text, lang=lang, source=source)
    measured = stored(with_counts(rows).drop("text"), "quality")
    kept = judged(measured, small(stored(fences(sketches(measured)), "fences"))).where("kept")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
