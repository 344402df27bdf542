"""Queries over scores, intervals, similarity and the audit's probes."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import stats as S
from corpusloom.functions import text as T
from corpusloom.functions import wellformed as W
from corpusloom.operators import matching as M
from corpusloom.operators.nearest import nearest_train
from corpusloom.operators import ml
from corpusloom.operators import pools as P
from corpusloom.operators.pools import scoped_hash
from corpusloom.plans import base as B
from corpusloom.plans.catalog import query
from corpusloom.plans.pool_queries import _CONFLICT_SQL, _MARKERS_SQL, _SCRUB_SQL, split_rows
from corpusloom.session import stored
from corpusloom.sources import readers

#: Fits that run at a time.
FITS = 8
Z = DEFAULT.z95


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    mid = f"({k} / {n} + {Z * Z} / (2 * {n})) / (1 + {Z * Z} / {n})"
    half = f"{Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4.0 * {n} * {n})) / (1 + {Z * Z} / {n})"
    return f"CASE WHEN {k} = 0 THEN 0 ELSE greatest(0, {mid} - {half}) END", f"CASE WHEN {k} = {n} THEN 1 ELSE least(1, {mid} + {half}) END"


_LO, _HI = _wilson_sql("k", "n")
_RATES = f"WITH {B.SCORED_SQL}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE score > 0.5) AS k FROM scored GROUP BY source), r AS (SELECT source, n, k, {_LO} AS lo, {_HI} AS hi FROM c)"


def _rates(spark, d):
    c = B.scored_documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("score") > DEFAULT.threshold).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return c.withColumns({"lo": lo, "hi": hi})


@query(_RATES + " SELECT source, n, k, round(k / n, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi, n < 30 AS small_n FROM r")
def q_wilson_by_source(spark, d):
    return _rates(spark, d).select("source", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), (F.col("n") < DEFAULT.small_n).alias("small_n"))


@query(_RATES + " SELECT a.source AS a, b.source AS b, round(a.lo, 6) AS lo_a, round(b.lo, 6) AS lo_b FROM r a JOIN r b ON a.source < b.source AND a.lo <= b.hi AND b.lo <= a.hi")
def q_interval_overlap_pairs(spark, d):
    """Pairs of sources whose intervals overlap; one row per source takes part."""
    r = _rates(spark, d)
    a, b = (r.select(F.col("source").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
    met = a.join(b, (F.col("a") < F.col("b")) & S.overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")))
    return met.select("a", "b", F.round("lo_a", 6).alias("lo_a"), F.round("lo_b", 6).alias("lo_b"))


def _score_sql(table: str, positive: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {key}n, n_pos, p, precision, recall, f1, floor, f1 - floor AS f1_minus_floor, CASE WHEN abs(1 - floor) < 1e-12 THEN NULL ELSE (f1 - floor) / nullif(1 - floor, 0) END AS f1_norm FROM
(SELECT *, n_pos / n AS p, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, 2 * (n_pos / n) / (1 + n_pos / n) AS floor FROM
(SELECT {key}count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 1 AND ({positive})) AS tp, count(*) FILTER (WHERE label <> 1 AND ({positive})) AS fp, count(*) FILTER (WHERE label = 1 AND NOT ({positive})) AS fn FROM {table} {group})))"""


_SCORES = ["p", "precision", "recall", "f1", "floor", "f1_minus_floor", "f1_norm"]
_ROUNDED = "n, n_pos, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in _SCORES)  # + 0: no negative zero


def _rounded(df, *keys):
    return df.select(*keys, "n", "n_pos", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _SCORES])


@query(f"WITH {B.SCORED_SQL} SELECT dataset, {_ROUNDED} FROM {_score_sql('scored', 'score > 0.5', 'dataset')}")
def q_rule_score_rows(spark, d):
    return _rounded(S.score_row(B.scored_documents(spark, d), "label", F.col("score") > DEFAULT.threshold, ["dataset"]), "dataset")


_TIED = "round(score, 2)"


@query(f"""WITH {B.SCORED_SQL}, t AS (SELECT dataset, {_TIED} AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dataset ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT dataset, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM r GROUP BY dataset""")
def q_roc_auc(spark, d):
    rows = B.scored_documents(spark, d).withColumn("s", F.round("score", 2))
    return S.roc_auc(rows, "label", "s", ["dataset"]).select("dataset", F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {B.SCORED_SQL}, t AS (SELECT dataset, {_TIED} AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM scored GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (PARTITION BY dataset ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT dataset, round(sum(pos * tp / seen) / nullif(sum(pos), 0), 6) AS pr_auc, round(sum(pos) / sum(n), 6) AS pr_auc_base FROM r GROUP BY dataset""")
def q_average_precision(spark, d):
    rows = B.scored_documents(spark, d).withColumn("s", F.round("score", 2))
    return S.average_precision(rows, "label", "s", ["dataset"]).select("dataset", F.round("pr_auc", 6).alias("pr_auc"), F.round("pr_auc_base", 6).alias("pr_auc_base"))


_GUESS = "CASE WHEN regexp_matches(text, '[ßüöä]') THEN 'de' WHEN regexp_matches(text, '[ñíó]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END"


@query(f"""WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents), c AS (SELECT DISTINCT lang AS class FROM g UNION SELECT DISTINCT guess FROM g),
t AS (SELECT class, (SELECT count(*) FROM g WHERE lang = class) AS support, (SELECT count(*) FROM g WHERE guess = class) AS guessed, (SELECT count(*) FROM g WHERE lang = class AND guess = class) AS tp FROM c),
m AS (SELECT avg(coalesce(2.0 * tp / nullif(support + guessed, 0), 0)) AS macro_f1, count(*) AS k, max(support) / sum(support) AS q FROM t)
SELECT round(macro_f1, 6) AS macro_f1, k, round(q, 6) AS q, round(2 * q / (1 + q) / k, 6) AS floor, round((macro_f1 - 2 * q / (1 + q) / k) / (1 - 2 * q / (1 + q) / k), 6) AS norm FROM m""")
def q_confusion_macro_f1(spark, d):
    """Languages guessed by their letters."""
    t = F.col("text")
    guess = F.when(t.rlike("[ßüöä]"), "de").when(t.rlike("[ñíó]"), "es").when(t.rlike("[éèêç]"), "fr").otherwise("en")
    m = S.macro_f1(readers.table(spark, d, "documents").withColumn("guess", guess), "lang", "guess")
    return m.select(F.round("macro_f1", 6).alias("macro_f1"), "k", F.round("q", 6).alias("q"), F.round("floor", 6).alias("floor"), F.round("norm", 6).alias("norm"))


@query(f"WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents) SELECT lang, count(*) FILTER (WHERE guess = 'de') AS de, count(*) FILTER (WHERE guess = 'en') AS en, count(*) FILTER (WHERE guess = 'es') AS es, count(*) FILTER (WHERE guess = 'fr') AS fr FROM g GROUP BY lang")
def q_confusion_matrix(spark, d):
    t = F.col("text")
    guess = F.when(t.rlike("[ßüöä]"), "de").when(t.rlike("[ñíó]"), "es").when(t.rlike("[éèêç]"), "fr").otherwise("en")
    return S.confusion(readers.table(spark, d, "documents").withColumn("guess", guess), "lang", "guess", ["de", "en", "es", "fr"])


_TEST = "substr(md5('42|near|' || conv_id || '|' || turn), 1, 1) < '3'"
_NEAR_SQL = rf"""t AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, role AS source, regexp_replace(text, '\s\s+', ' ', 'g') AS x, {_TEST} AS test FROM conversations),
u AS MATERIALIZED (SELECT id, source, test, unnest(list_distinct(list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4)))) AS gram FROM t),
n AS (SELECT id, count(*) AS n FROM u GROUP BY id),
p AS (SELECT a.id, b.id AS other, count(*) AS k FROM u a JOIN u b ON a.gram = b.gram AND a.source = b.source WHERE a.test AND NOT b.test GROUP BY a.id, b.id),
j AS (SELECT p.id, max(k / (a.n + b.n - k)) AS j FROM p JOIN n a ON a.id = p.id JOIN n b ON b.id = p.other GROUP BY p.id),
near AS (SELECT t.id, t.source, coalesce(j, 0) AS jaccard FROM t LEFT JOIN j USING (id) WHERE test)"""


def _turns(spark, d):
    """Turns as rows, a part of them as test rows."""
    test = F.substring(scoped_hash("near", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 1, 1) < "3"
    return readers.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("source"), F.col("text").alias("command"), test.alias("test"))


@query(f"WITH {_NEAR_SQL} SELECT id, source, round(jaccard, 9) AS jaccard FROM near")
def q_nearest_train(spark, d):
    """Nearest train neighbour of every test turn by 4-gram Jaccard of whole texts, within its role."""
    rows = _turns(spark, d)
    return nearest_train(rows.where("test"), rows.where("not test")).select("id", "source", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH {_NEAR_SQL} SELECT source, count(*) AS n, round(median(jaccard), 6) AS median, round(quantile_cont(jaccard, 0.9), 6) AS p90, round(max(jaccard), 6) AS worst, count(*) FILTER (WHERE jaccard >= 0.9) AS strict, count(*) FILTER (WHERE jaccard >= 0.8) AS loose FROM near GROUP BY source")
def q_neardup_jaccard(spark, d):
    """Per role how near test turns come to train turns."""
    rows = _turns(spark, d)
    best = nearest_train(rows.where("test"), rows.where("not test"))
    j = F.col("jaccard")
    return best.groupBy("source").agg(F.count("*").alias("n"), F.round(F.percentile(j, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(j, F.lit(0.9)), 6).alias("p90"), F.round(F.max(j), 6).alias("worst"), F.count_if(j >= DEFAULT.neardup_strict).alias("strict"), F.count_if(j >= DEFAULT.neardup_loose).alias("loose"))


_MARK = r"(?i)\b(the|la|der)\b"


@query(rf"""WITH {B.SCORED_SQL}, m AS (SELECT *, regexp_matches(text, '{_MARK}') AS hit FROM scored)
SELECT {_ROUNDED}, recall >= 0.5 AS fired, CASE WHEN recall >= 0.5 THEN 'FAIL' WHEN recall > 0.3 THEN 'INFO' ELSE 'PASS' END AS verdict FROM {_score_sql('m', 'hit')}""")
def q_selection_regex_probe(spark, d):
    """A keyword rule as a classifier: it must not find the label."""
    rows = B.scored_documents(spark, d).withColumn("hit", F.col("text").rlike(_MARK))
    out = _rounded(S.score_row(rows, "label", F.col("hit")))
    recall = F.col("recall")
    return out.withColumns({"fired": recall >= 0.5, "verdict": F.when(recall >= 0.5, "FAIL").when(recall > 0.3, "INFO").otherwise("PASS")})


@query(f"""WITH {B.SCORED_SQL} SELECT 'always' AS rule, {_ROUNDED} FROM {_score_sql('scored', 'true')} UNION ALL SELECT 'has_ip', {_ROUNDED} FROM {_score_sql('scored', 'has_ip')} UNION ALL SELECT 'length', {_ROUNDED} FROM {_score_sql('scored', 'score > 0.5')}""")
def q_single_feature_probe(spark, d):
    """Always-positive, contains-an-address and length rules, each beside its floor; one pass."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("positive")) for n, c in (("always", F.lit(True)), ("has_ip", F.col("has_ip")), ("length", F.col("score") > DEFAULT.threshold))])
    rows = B.scored_documents(spark, d).select("label", F.inline(rules))
    return _rounded(S.score_row(rows, "label", F.col("positive"), ["rule"]), "rule")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) FILTER (WHERE trim(text) = '') AS n_blank FROM documents")
def q_roundtrip_guard(spark, d):
    return readers.table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"), F.count_if(F.trim("text") == "").alias("n_blank"))


_MATCH_SQL = f"""{B.SCORED_SQL}, q AS MATERIALIZED (SELECT dataset, label, doc_id AS id, length(text) AS n FROM scored),
att AS (SELECT dataset, id, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, id) AS k FROM q WHERE label = 1),
st AS (SELECT dataset, 0::BIGINT AS k, 0::BIGINT AS bias, list({{'id': id, 'n': n}}) FILTER (WHERE label = 0) AS pool, NULL::BIGINT AS attack, NULL::BIGINT AS normal, NULL::BIGINT AS length_a, NULL::BIGINT AS length_b FROM q GROUP BY dataset
 UNION ALL SELECT dataset, k + 1, bias + coalesce(p['n'] - l, 0), CASE WHEN p IS NULL THEN pool ELSE list_filter(pool, lambda y: y['id'] <> p['id']) END, a, p['id'], l, p['n'] FROM
 (SELECT st.dataset, st.k, bias, pool, att.id AS a, att.n AS l, list_sort(list_transform(list_filter(pool, lambda y: abs(y['n'] - att.n) <= greatest(5, round_even(0.1 * att.n, 0))), lambda y: {{'d': abs(y['n'] - att.n), 's': CASE WHEN bias < 0 THEN att.n - y['n'] ELSE y['n'] - att.n END, 'id': y['id'], 'n': y['n']}}))[1] AS p
  FROM st JOIN att ON att.dataset = st.dataset AND att.k = st.k + 1)),
pairs AS (SELECT dataset, attack, normal, length_a, length_b FROM st WHERE normal IS NOT NULL)"""
_RECORD_SQL = f"""WITH RECURSIVE {_MATCH_SQL}, b AS (SELECT dataset, count(*) FILTER (WHERE label = 1) AS n_malicious, count(*) FILTER (WHERE label = 0) AS n_benign_pool, median(n) FILTER (WHERE label = 1) AS median_len_mal_before, median(n) FILTER (WHERE label = 0) AS median_len_ben_before FROM q GROUP BY dataset),
f AS (SELECT dataset, count(*) AS n_matched, median(length_a) AS median_len_mal_after, median(length_b) AS median_len_ben_after, avg(length_a) AS mean_len_mal_after, avg(length_b) AS mean_len_ben_after, median(abs(length_a - length_b)) AS median_abs_pair_diff, max(abs(length_a - length_b))::DOUBLE AS max_abs_pair_diff FROM pairs GROUP BY dataset)
SELECT *, n_matched / n_malicious AS coverage, 'max(5 chars, 10% of length)' AS tolerance, abs(median_len_mal_after - median_len_ben_after) <= greatest(5, 0.1 * greatest(median_len_mal_after, median_len_ben_after)) AS medians_matched, n_matched / n_malicious < 0.5 AS warning FROM b JOIN f USING (dataset)"""
_MATCHED = ["n_malicious", "n_matched", "n_benign_pool", "coverage", "tolerance", "median_len_mal_before", "median_len_ben_before", "median_len_mal_after", "median_len_ben_after", "mean_len_mal_after", "mean_len_ben_after", "median_abs_pair_diff", "max_abs_pair_diff", "medians_matched", "warning"]


def _lengths(spark, d):
    return B.scored_documents(spark, d).select("dataset", "label", F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))


@query(f"WITH RECURSIVE {_MATCH_SQL} SELECT * FROM pairs")
def q_length_match(spark, d):
    """Labelled documents matched one to one by length."""
    return M.length_match(_lengths(spark, d), ["dataset"])


@query(_RECORD_SQL)
def q_length_record(spark, d):
    """What that match covers, per dataset."""
    rows = stored(_lengths(spark, d), "lengths")
    return M.length_record(rows, M.length_match(rows, ["dataset"]), ["dataset"]).select("dataset", *_MATCHED)


@query()
def q_difflib_share(spark, d):
    """Test turns with a near copy in train by sequence-matcher ratio, per role."""
    rows = _turns(spark, d)
    t = M.difflib_share(rows.where("test"), rows.where("not test"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return t.withColumns({"lo": lo, "hi": hi})


@query(_RATES + f""", v AS (SELECT row_number() OVER (ORDER BY source) - 1 AS at, k / n AS rate FROM r),
b AS (SELECT d.range AS id, avg(v.rate) AS m FROM range({DEFAULT.bootstrap_rounds}) d, range((SELECT count(*) FROM v)) i JOIN v ON v.at = ('0x' || substr(md5('42|boot|' || d.range || '|' || i.range), 1, 8))::BIGINT % (SELECT count(*) FROM v) GROUP BY d.range)
SELECT (SELECT count(*) FROM v)::INT AS k, round((SELECT avg(rate) FROM v), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM b""")
def q_bootstrap_mean(spark, d):
    """A percentile bootstrap of the mean of per-source rates: resamples by hash, 2,000 rounds."""
    rates = _rates(spark, d).select((F.col("k") / F.col("n")).alias("rate"), "source")
    values = [r["rate"] for r in rates.orderBy("source").collect()]  # one number per source
    if len(values) < 2:
        return spark.createDataFrame([(len(values), None, None, None)], "k int, mean double, lo double, hi double")
    draws = spark.range(DEFAULT.bootstrap_rounds).select("id", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("i"))
    digest = scoped_hash("boot", F.col("id").cast("string"), F.col("i").cast("string"))
    pick = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(values)).cast("int")
    means = draws.select("id", F.get(F.array(*map(F.lit, values)), pick).alias("v")).groupBy("id").agg(F.avg("v").alias("m"))
    end = lambda p: F.round(F.percentile("m", F.lit(p)), 9)
    return means.agg(F.lit(len(values)).alias("k"), F.lit(round(sum(values) / len(values), 9)).alias("mean"), end(0.025).alias("lo"), end(0.975).alias("hi"))


def _sides(spark, d):
    return split_rows(spark, d).select("command", "label", "source", "dataset", "split")


def _fitted(train, at_once=1):
    return ml.Baseline().fit(train, at_once)


def _scored(score, rows):
    """Labels and scores of rows, written: several measures read them, and each would make the vectors again."""
    return stored(score(ml.spread(rows)).select("label", "score", "prediction"), "scores")


@query()
def q_baseline_scores(spark, d):
    """The baseline on the held-out side of each dataset, and on its rows without addresses."""
    from corpusloom.functions.text import strip_addresses

    rows, out = _sides(spark, d), None
    with ThreadPool(FITS) as pool:
        scores = pool.map(lambda k: _fitted(rows.where((F.col("dataset") == k) & (F.col("split") == "train")), 2), (1, 2))
    for k, score in zip((1, 2), scores, strict=True):
        test = rows.where((F.col("dataset") == k) & (F.col("split") == "test"))
        for name, part in (("full", test), ("no_addresses", test.withColumn("command", strip_addresses(F.col("command"))))):
            one = S.make_row(_scored(score, part), "label", score="score").select(F.lit(k).alias("dataset"), F.lit(name).alias("setting"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query()
def q_transfer(spark, d):
    """Fitted on one dataset's train side, scored on all of the other."""
    rows, out = _sides(spark, d), None
    with ThreadPool(FITS) as pool:
        scores = pool.map(lambda k: _fitted(rows.where((F.col("dataset") == k) & (F.col("split") == "train")), 2), (1, 2))
    for (a, b), score in zip(((1, 2), (2, 1)), scores, strict=True):
        one = S.make_row(_scored(score, rows.where(F.col("dataset") == b)), "label", score="score").select(F.lit(a).alias("train"), F.lit(b).alias("test"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q_loso(spark, d):
    """Recall on the test rows of every attack source with it in training (k_full) and left out of it (k_out), per dataset.

    Each model has its own vocabulary. A source without which training has one class is a row
    that says why it was skipped.
    """
    rows = _sides(spark, d)
    counts = rows.groupBy("dataset", "source", "label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")).collect()  # a row per source and label
    hits = lambda t: t.agg(F.count_if(F.col("score") > DEFAULT.threshold).alias("k")).first()["k"]

    def side(k):
        own = [r for r in counts if r["dataset"] == k]
        held = {r["source"]: r["test"] for r in own if r["label"] == 1 and r["test"]}
        removed = {s: sum(r["train"] for r in own if r["source"] == s) for s in held}
        names = sorted(s for s in held if len({r["label"] for r in own if r["source"] != s and r["train"]}) == 2)
        train, test = rows.where((F.col("dataset") == k) & (F.col("split") == "train")), rows.where((F.col("dataset") == k) & (F.col("split") == "test") & (F.col("label") == 1))
        if names:
            full = {r["source"]: r["k"] for r in _fitted(train, 2)(test).groupBy("source").agg(F.count_if(F.col("score") > DEFAULT.threshold).alias("k")).collect()}
            out = ml.Baseline().fit_without(train, test, "source", names, FITS // 2, hits)
        return [(k, s, held[s], full[s], out[s], removed[s], None) if s in names else (k, s, held[s], None, None, removed[s], "removing it leaves train single-class") for s in sorted(held)]

    with ThreadPool(2) as pool:
        found = [row for part in pool.map(side, (1, 2)) for row in part]
    t = spark.createDataFrame(found, "dataset int, source string, n long, k_full long, k_out long, train_rows_removed long, skipped string")
    (lo_full, hi_full), (lo_out, hi_out) = (S.wilson(F.col(c), F.col("n")) for c in ("k_full", "k_out"))
    rate = F.col("k_out") / F.col("n")
    fate = F.when(rate.isNotNull(), F.when(rate >= 0.9, "kept").when(rate < 0.5, "lost").otherwise("weakened"))
    return t.withColumns({"lo_full": lo_full, "hi_full": hi_full, "lo_out": lo_out, "hi_out": hi_out, "fate": fate})


@query()
def q_source_separability(spark, d):
    """Whether a classifier can tell normal rows of one language from another, with floor and headroom."""
    docs = readers.table(spark, d, "documents")
    rows = docs.select(F.col("text").alias("command"), "lang", F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")).cast("int").alias("label"), "doc_id")
    test = F.substring(scoped_hash("sep", F.col("doc_id").cast("string")), 1, 1) < "4"
    rows = rows.withColumn("test", test).withColumn("label", (F.col("label") - 1).cast("double"))
    out = _scored(_fitted(rows.where("not test")), rows.where("test"))
    m = S.macro_f1(out, "label", "prediction")
    raw, norm = F.col("macro_f1"), F.col("norm")
    return m.withColumn("verdict", F.when((raw > 0.90) | (norm > 0.85), "FAIL").when((raw > 0.75) | (norm > 0.75), "INFO").otherwise("PASS"))


_CONFLICT_COUNTS = f"""WITH {_CONFLICT_SQL}, f AS (SELECT dataset, count(*) FILTER (WHERE label = 0 AND regexp_matches(command, '{_SCRUB_SQL}')) AS n, count(*) FILTER (WHERE label = 0) AS k FROM labelled GROUP BY dataset)
SELECT dataset, 'exact' AS kind, exact AS n FROM report UNION ALL SELECT dataset, 'shape', rows_hit FROM report UNION ALL SELECT dataset, 'scrub', n FROM f WHERE k > 0"""


@query(_CONFLICT_COUNTS)
def q_pool_conflict_routes(spark, d):
    """Rows that a build would drop over their label, by the way they are found: the text, its shape, or an attack's form on a normal row."""
    rows = B.labelled(spark, d)
    report, _ = P.shape_conflicts(rows)
    scrub = rows.where("label = 0").groupBy("dataset").agg(F.count_if(W.needs_scrub(F.col("command"))).alias("n"))
    named = lambda df, kind, c: df.select("dataset", F.lit(kind).alias("kind"), F.col(c).alias("n"))
    return named(report, "exact", "exact").unionByName(named(report, "shape", "rows_hit")).unionByName(named(scrub, "scrub", "n"))


# documents as sessions, annotated by their labels
_SESSION_SQL = f"""ses AS (SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN ['Execution'] WHEN l.quality = 1 THEN ['Harmless'] WHEN l.quality = 0 THEN ['Harmless', 'Discovery'] END AS fp FROM documents d LEFT JOIN labels l USING (doc_id)),
tok AS (SELECT doc_id, fp, list_transform(regexp_extract_all(text, '{T.SESSION_TOKEN.replace("'", "''")}'), lambda x: CASE WHEN x IN (';', chr(10), '&&', '||') THEN chr(57344) ELSE x END) AS a FROM ses),
cut AS (SELECT doc_id, fp, list_filter(list_transform(string_split(array_to_string(a, ''), chr(57344)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a FROM tok),
ato AS (SELECT doc_id, coalesce(fp = ['Harmless'], false) AS harmless, unnest(a) AS raw, generate_subscripts(a, 1) AS pos FROM cut), nor AS MATERIALIZED (SELECT *, {B.normalize_sql('raw')} AS command FROM ato),
com AS (SELECT command, arg_min(raw, (doc_id, pos)) AS raw, bool_and(harmless) AS harmless FROM nor WHERE {B.USABLE_SQL} GROUP BY command),
rep AS MATERIALIZED (SELECT *, {B._NO_RULE} AS fine FROM com)"""


def _sessions(spark, d):
    labels = readers.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    fp = F.when(F.col("toxic") == 1, F.array(F.lit("Execution"))).when(F.col("quality") == 1, F.array(F.lit("Harmless"))).when(F.col("quality") == 0, F.array(F.lit("Harmless"), F.lit("Discovery")))
    return readers.table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("full_session"), fp.alias("Set_Fingerprint"))


@query(f"""WITH {_SESSION_SQL} SELECT (SELECT count(*) FROM documents) AS sessions, count(*) AS distinct_atoms, count(*) FILTER (WHERE NOT fine) AS well_formed_dropped, count(*) FILTER (WHERE fine) AS after_well_formed,
count(*) FILTER (WHERE fine AND harmless) AS harmless_only_dropped, count(*) FILTER (WHERE fine AND NOT harmless) AS after_harmless_drop, count(*) FILTER (WHERE fine AND NOT harmless AND regexp_matches(command, '{_MARKERS_SQL}')) AS marker_probe_pool_coverage FROM rep""")
def q_session_pool(spark, d):
    """What becomes of the commands of sessions: documents, annotated by their labels."""
    return readers.session_pool(_sessions(spark, d), ["doc_id"])[1]


@query(f"""WITH {B.LABELLED_SQL}, {_SESSION_SQL},
one AS (SELECT count(*) FILTER (WHERE fine AND harmless) AS hits, count(*) FILTER (WHERE fine) AS n FROM rep),
two AS (SELECT sum(length(text)) FILTER (WHERE role = 'system')::BIGINT AS hits, sum(length(text))::BIGINT AS n FROM conversations),
three AS (SELECT count(*) FILTER (WHERE regexp_matches(command, '(?i)^(?:{W.INNOCUOUS.replace("'", "''")})\\s*$')) AS hits, count(*) AS n FROM labelled WHERE dataset = 2 AND label = 1),
u AS (SELECT 'route1_set_fingerprint' AS route, * FROM one UNION ALL SELECT 'route2_annotations', * FROM two UNION ALL SELECT 'route3_innocuous_in_isolation', * FROM three)
SELECT route, coalesce(hits, 0) AS hits, n, round(coalesce(hits, 0) / greatest(n, 1), 5) AS share FROM u""")
def q_label_noise(spark, d):
    """Label noise by three routes that look at different things: commands seen in harmless sessions alone, statements
    annotated as harmless (turns, by their length, with the system's as harmless), and malicious rows innocuous by themselves."""
    _, report = readers.session_pool(_sessions(spark, d), ["doc_id"])
    one = report.select(F.lit("route1_set_fingerprint").alias("route"), F.col("harmless_only_dropped").alias("hits"), F.col("after_well_formed").alias("n"))
    tactic = F.when(F.col("role") == "system", "Harmless").otherwise("Other")
    runs = readers.table(spark, d, "conversations").select(F.concat(tactic, F.lit(" - "), F.length("text").cast("string")).alias("labels"))
    two = readers.harmless_rate(readers.run_lengths(runs)).select(F.lit("route2_annotations").alias("route"), F.col("harmless").alias("hits"), F.col("statements").alias("n"))
    rows = B.labelled(spark, d).where("dataset = 2 and label = 1")
    three = rows.agg(F.lit("route3_innocuous_in_isolation").alias("route"), F.count_if(W.innocuous_alone(F.col("command"))).alias("hits"), F.count("*").alias("n"))
    return one.unionByName(two).unionByName(three).withColumn("share", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 5))


@query()
def q_pairwise_separability(spark, d):
    """Fits of every pair of languages' documents against each other: macro-F1, floor, headroom, and the mean's verdict.

    A pair with fewer than 25 rows of a side in training or 10 in test is skipped; sides are
    capped at 3,000 rows by hash, which is the probe's own rule.
    """
    test = F.substring(scoped_hash("sep", F.col("doc_id").cast("string")), 1, 1) < "4"
    docs = readers.table(spark, d, "documents").select(F.col("text").alias("command"), "lang", "doc_id", test.alias("test"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(scoped_hash("pair", F.col("doc_id").cast("string")), "doc_id"))
    # ranks are made of ids alone, so no window holds a text
    few = docs.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= DEFAULT.separability_cap).select("doc_id")
    docs = stored(docs.join(few, "doc_id", "left_semi"), "sides")
    sizes = {r["lang"]: (r["train"], r["test"]) for r in docs.groupBy("lang").agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test")).collect()}  # a row per side
    good = sorted(x for x, (a, b) in sizes.items() if x is not None and a >= DEFAULT.separability_min_train and b >= DEFAULT.separability_min_test)

    def one(pair):
        rows = docs.where(F.col("lang").isin(*pair)).withColumn("label", (F.col("lang") == pair[1]).cast("double"))
        out = _scored(_fitted(rows.where("not test"), FITS), rows.where("test"))
        return S.macro_f1(out, "label", "prediction").first()

    pairs = [(a, b) for i, a in enumerate(good) for b in good[i + 1 :]]
    with ThreadPool(FITS) as pool:
        found = pool.map(one, pairs)
    rows = [(a, b, r["macro_f1"], r["floor"], r["norm"]) for (a, b), r in zip(pairs, found, strict=True)]
    out = spark.createDataFrame(rows, "a string, b string, macro_f1 double, floor double, norm double")
    every = Window.partitionBy()
    bad = (F.avg("macro_f1").over(every) > 0.90) | (F.avg("norm").over(every) > 0.85)
    return out.withColumns({"exact": F.col("macro_f1") >= 1.0, "verdict": F.when(bad, "FAIL").otherwise("PASS")})


@query()
def q_length_model(spark, d):
    """The length-only model on the test side of each dataset, whole and matched by length."""
    rows, out = _sides(spark, d).withColumns({"id": F.xxhash64("command"), "n": F.length("command").cast("long")}), None
    for k in (1, 2):
        own = rows.where(F.col("dataset") == k)
        test = own.where("split = 'test'")
        pairs = M.length_match(test, ["dataset"])
        matched = test.join(pairs.select(F.explode(F.array("attack", "normal")).alias("id")), "id", "left_semi")
        score = ml.length_model(own.where("split = 'train'"))
        for name, part in (("test", test), ("matched", matched)):
            one = S.make_row(score(part), "label", score="score").select(F.lit(k).alias("dataset"), F.lit(name).alias("setting"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query()
def q_probe_summary(spark, d):
    """The probes that need no fit, with their verdicts: selection regex, rows per shape and cap on the pool, straddle, near-dup."""
    scored = B.scored_documents(spark, d).withColumn("hit", W.has_marker(F.col("text")))
    recall = S.score_row(scored, "label", F.col("hit")).select(F.lit("selection_regex").alias("probe"), F.col("recall").alias("value"))
    pool = B.shaped(spark, d)
    least = P.pool_shapes(pool, ["source"], "shape").agg(F.min("rows_per_shape").alias("value")).select(F.lit("rows_per_shape").alias("probe"), "value")
    capped = P.pool_shapes(P.cap_per_shape(pool, ["source"], "shape", "command"), ["source"], "shape").agg(F.max("max_in_shape").cast("double").alias("value")).select(F.lit("cap").alias("probe"), "value")
    split = split_rows(spark, d)
    over = split.groupBy("label", "shape", "dataset").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).cast("double").alias("value")).select(F.lit("straddle").alias("probe"), "value")
    rows = split.withColumn("id", F.xxhash64("command"))
    near = nearest_train(rows.where("split = 'test'"), rows.where("split = 'train'"))
    near = near.groupBy("source").agg(F.avg((F.col("jaccard") >= DEFAULT.neardup_strict).cast("int")).alias("share")).agg(F.max("share").alias("value")).select(F.lit("near_dup").alias("probe"), "value")
    out = recall.unionByName(least).unionByName(capped).unionByName(over).unionByName(near)
    v, p = F.col("value"), F.col("probe")
    verdict = F.when(p == "selection_regex", F.when(v >= 0.5, "FAIL").when(v > 0.3, "INFO")).when(p == "rows_per_shape", F.when(v < 1.5, "FAIL").when(v < 10, "INFO"))
    verdict = verdict.when(p == "cap", F.when(v > DEFAULT.max_per_shape, "FAIL")).when(p == "straddle", F.when(v > 0, "FAIL")).when(p == "near_dup", F.when(v >= 0.10, "FAIL"))
    return out.withColumn("verdict", F.coalesce(verdict, F.lit("PASS")))
