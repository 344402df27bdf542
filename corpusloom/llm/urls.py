"""URL filters: rules first, then a ratio of character language models.

A rule is a host and a path; it fits that host and all its subdomains if the url's path
starts with the rule's, and the longest rule that fits wins. Urls that no rule fits are
judged by two smoothed variable-order Markov models, of accepted and of rejected urls:
the score is the difference of their log likelihoods per character, and urls at or above
a calibrated threshold are allowed.

The models read the whole url after ``://``, with its query and fragment (a url without
``://`` as it is), the host in lower case. They come from the urls that rules fit, over
the whole table: four fifths (by hash) are counted, on the last fifth the threshold is
set where the two error rates have the least sum; if that fifth lacks one kind, it is 0.
A model interpolates orders 0 to ``ORDER`` by how many different characters followed a
context (Witten-Bell), down to an even chance for each character that occurs anywhere.

Counts are a table of (context, character) rows, exact, as many as the corpus has: they
are aggregated, smoothed and looked up by joins, order by order, and nothing of them
reaches the driver but the histogram of scores. What is smoothed are distinct strings of
ORDER + 1 characters, so a host that most urls share is looked up once.

Null urls have an empty host and path, no rule, and the score of the empty text, 0. If
rules give only one kind of example, every url without a rule gets that kind's verdict,
and without any example it is allowed. Repeated rows get equal verdicts, and count as
often as they occur. An empty table gives no rows. Ids keep their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import settled
from corpusloom.session import stored

#: The rules of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 4
#: Stands before a url's first character.
START = "\x02"
#: One part in so many of the ruled urls calibrates the threshold.
HOLD_OUT = 5
#: Width of the score histogram's bars.
BAR = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def model_text(url: Column) -> Column:
    """What the models read of a url: all after ``://``, the host in lower case."""
    at = F.instr(url, F.lit("://"))
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(url), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.translate(host, UPPER, LOWER), rest.substr(F.length(host) + 1, F.length(rest)))


def grams(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each character: ``gram`` is the character after the ORDER ones before it."""
    rows = settled(df, _c=F.split(F.concat(F.lit(START * ORDER), F.col(text)), ""))
    n = F.size("_c") - ORDER
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return rows.withColumn("gram", F.explode(F.transform(at, lambda i: F.concat(*[F.get("_c", i + k) for k in range(ORDER + 1)])))).drop("_c")


def counted(ruled: DataFrame) -> DataFrame:
    """(gram, good, bad): how often each string of ORDER + 1 characters occurs in accepted and in rejected urls."""
    good = F.col("verdict") == "allow"
    return grams(ruled.select("text", "verdict")).groupBy("gram").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


def gains(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, gain) of the wanted grams: log of the accepted model's probability less that of the rejected one's.

    A window holds a context's characters, at most as many as there are different ones.
    """
    none = F.lit(0).cast("long")
    both = counts.withColumn("asked", F.lit(False)).unionByName(wanted.select("gram", none.alias("good"), none.alias("bad"), F.lit(True).alias("asked")))
    lower = None
    for order in range(ORDER + 1):
        rows = both.groupBy(F.right("gram", F.lit(order + 1)).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("asked").alias("asked"))
        w = Window.partitionBy("context")
        rows = rows.withColumn("context", F.left("gram", F.lit(order)))
        rows = rows.withColumns({c: e for k in ("good", "bad") for c, e in ((f"{k}_n", F.sum(k).over(w)), (f"{k}_t", F.count_if(F.col(k) > 0).over(w)))})
        if lower is None:
            even = 1 / F.greatest(F.lit(1.0), F.count_if(F.col("good") + F.col("bad") > 0).over(w))
            rows = rows.withColumns({"p_good": even, "p_bad": even}).where("asked")
        else:
            rows = rows.where("asked").withColumn("shorter", F.right("gram", F.lit(order))).join(lower, "shorter")
        smooth = lambda k: F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_t") * F.col(f"p_{k}")) / (F.col(f"{k}_n") + F.col(f"{k}_t"))).otherwise(F.col(f"p_{k}"))
        lower = rows.select(F.col("gram").alias("shorter"), smooth("good").alias("p_good"), smooth("bad").alias("p_bad"))
    return lower.select(F.col("shorter").alias("gram"), (F.log("p_good") - F.log("p_bad")).alias("gain"))


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(text, score) of distinct texts; texts without a character have score 0."""
    rows = urls.select("text").distinct()
    places = grams(rows)
    table = stored(gains(counts, places.select("gram").distinct()), "gains")
    sums = places.join(table, "gram").groupBy("text").agg((F.sum(F.round("gain", 12).cast("decimal(30,12)")) / F.count("*")).cast("double").alias("score"))
    return rows.where("text = ''").select("text", F.lit(0.0).alias("score")).unionByName(sums)


def calibrate(held: DataFrame) -> float:
    """The threshold with the least sum of error rates on scored urls, of 0 and the borders of scores that occur; ties go to the one nearest 0, and without both kinds it is 0."""
    bars = held.groupBy(F.floor(F.col("score") / BAR).alias("bar"), "verdict").agg(F.count("*").alias("n"))
    rows = bars.collect()  # scores lie between the logs of the least and greatest likelihood: bounded
    good, bad = ({r["bar"]: r["n"] for r in rows if r["verdict"] == v} for v in ("allow", "block"))
    if not good or not bad:
        return 0.0
    edges = sorted({0, *good, *bad, *(k + 1 for k in (*good, *bad))})  # between kinds that lie apart, 0 is as good as any
    n_good, n_bad = sum(good.values()), sum(bad.values())
    lost, passed, best = 0, n_bad, []
    for e in edges:
        best.append((lost / n_good + passed / n_bad, abs(e), e))
        lost += good.get(e, 0)
        passed -= bad.get(e, 0)
    return min(best)[2] * BAR


def _part(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "text"), F.lit(HOLD_OUT))


def fitted(ruled: DataFrame, others: DataFrame) -> tuple[DataFrame, float]:
    """The scores (text, score) of ``others`` and the threshold, from ruled (text, verdict), of which both kinds occur."""
    counts = stored(counted(ruled.where(_part("part") > 0)), "counts")
    held = ruled.where(_part("part") == 0)
    scores = stored(scored(held.select("text").unionByName(others.select("text")), counts), "scores")
    return scores, calibrate(held.select("text", "verdict").join(scores, "text"))


def held_out(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, masked: bool = True) -> DataFrame:
    """How models fitted on four fifths of the ruled urls judge the last fifth: (verdict, n, right).

    With ``masked`` the host and path that a rule names are taken out of what the models
    read, so that they cannot learn the rule itself.
    """
    host, path = host_and_path(F.col(url))
    rule, verdict = fitting_rule(host, path, RULES if rules is None else rules)
    text = model_text(F.col(url))
    if masked:
        ruled_host = F.substring_index(rule, "/", 1)
        left = host.substr(F.lit(1), F.length(host) - F.length(ruled_host))
        text = F.concat(left, text.substr(F.length(host) + F.length(rule) - F.length(ruled_host) + 1, F.length(text)))
    ruled = stored(pages.select(rule.alias("rule"), verdict.alias("verdict"), text.alias("text")).where("verdict is not null"), "ruled")
    held = ruled.where(_part("held") == 0)
    scores, limit = fitted(ruled.where(_part("held") > 0), held)
    judged = held.join(scores, "text").withColumn("said", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("verdict")).alias("right"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Per url: page_id, host, path, rule, verdict and score (null where a rule decides)."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    own = own.select("page_id", host.alias("host"), path.alias("path"), model_text(F.col("url")).alias("text"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    own = stored(own.select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    decided = own.where("verdict is not null").withColumn("score", F.lit(None).cast("double"))
    rest = own.where("verdict is null").drop("verdict")
    kinds = {r["verdict"] for r in decided.select("verdict").distinct().collect()}  # at most two
    if len(kinds) == 2:
        scores, limit = fitted(decided, rest)
        open_ = rest.join(scores, "text")
        open_ = open_.withColumn("verdict", F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block"))
    else:
        open_ = rest.withColumns({"score": F.lit(0.0), "verdict": F.lit("block" if kinds == {"block"} else "allow")})
    return decided.unionByName(open_).select("page_id", "host", "path", "rule", "verdict", "score")
