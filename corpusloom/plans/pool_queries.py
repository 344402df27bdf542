"""Queries over pools: caps, deals, conflicts, balance, splits, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import wellformed as W
from corpusloom.operators import pools as P
from corpusloom.plans import base as B
from corpusloom.plans.catalog import query
from corpusloom.session import stored
from corpusloom.sources import readers



def _turns(site: str, table: str = "shaped") -> str:
    """A round-robin deal over shapes within sources, in SQL."""
    return f"""dealt AS (SELECT *, row_number() OVER (PARTITION BY source, shape ORDER BY md5('42|{site}|' || command), command) AS rnd FROM {table}),
turns AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rnd, md5('42|{site}|' || shape), shape) AS turn FROM dealt)"""


@query(f"WITH {B.SHAPED_SQL}, {_turns('cap')} SELECT source, md5(command) AS digest FROM dealt WHERE rnd <= 2")
def q_shape_cap(spark, d):
    return P.cap_per_shape(B.shaped(spark, d), ["source"], "shape", "command").select("source", F.md5("command").alias("digest"))


@query(f"WITH {B.SHAPED_SQL}, {_turns('ceiling')} SELECT source, count(*) AS kept, count(DISTINCT shape) AS n_shapes FROM turns WHERE turn <= 100 GROUP BY source")
def q_source_ceiling(spark, d):
    """A row ceiling per source, dealt over shapes (the ceiling is the feature)."""
    rows = P.deal(B.shaped(spark, d), ["source"], "shape", "command", "ceiling", most=100)
    return rows.groupBy("source").agg(F.count("*").alias("kept"), F.count_distinct("shape").alias("n_shapes"))


@query(f"WITH {B.SHAPED_SQL}, {_turns('take')} SELECT source, md5(command) AS digest, rnd AS round FROM turns WHERE turn <= 50")
def q_roundrobin_take(spark, d):
    return P.deal(B.shaped(spark, d), ["source"], "shape", "command", "take", most=50).select("source", F.md5("command").alias("digest"), "round")


@query("SELECT label, doc_id FROM (SELECT toxic AS label, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|strat|' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 25")
def q_strat_cap(spark, d):
    rows = readers.table(spark, d, "labels").select(F.col("toxic").alias("label"), "doc_id")
    rows = rows.withColumn("h", P.scoped_hash("strat", F.col("doc_id").cast("string")))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).where("rn <= 25").select("label", "doc_id")


@query(f"""WITH {B.POOL_SQL}, s AS (SELECT command FROM (SELECT DISTINCT command FROM pool) ORDER BY md5('42|overlap|' || command), command LIMIT 500), k AS (SELECT DISTINCT text FROM benchmark), kl AS (SELECT DISTINCT lower(text) AS text FROM benchmark)
SELECT count(*) AS n, count(*) FILTER (WHERE command IN (SELECT text FROM k)) AS exact, count(*) FILTER (WHERE lower(command) IN (SELECT text FROM kl)) AS folded FROM s""")
def q_hash_sample_overlap(spark, d):
    """A seeded sample of 500 against a reference pool, case kept and folded."""
    s = B.pool(spark, d).select("command").distinct().orderBy(P.scoped_hash("overlap", "command"), "command").limit(500)
    known = readers.table(spark, d, "benchmark").select("text")
    k = known.distinct().select(F.col("text").alias("command"), F.lit(1).alias("exact"))
    kl = known.select(F.lower("text").alias("low")).distinct().withColumn("folded", F.lit(1))
    s = s.join(k, "command", "left").withColumn("low", F.lower("command")).join(kl, "low", "left")
    return s.agg(F.count("*").alias("n"), F.count("exact").alias("exact"), F.count("folded").alias("folded"))


_EXACT_SQL = "exact AS (SELECT command FROM labelled GROUP BY command HAVING min(label) <> max(label))"
_CONFLICT_SQL = f"""{B.LABELLED_SQL}, {_EXACT_SQL},
marked AS (SELECT l.*, e.command IS NOT NULL AS is_exact FROM labelled l LEFT JOIN exact e USING (command)),
both_ AS (SELECT dataset, shape FROM marked WHERE NOT is_exact GROUP BY ALL HAVING min(label) <> max(label)),
hit AS (SELECT m.*, NOT is_exact AND b.shape IS NOT NULL AS is_hit FROM marked m LEFT JOIN both_ b ON m.dataset = b.dataset AND m.shape = b.shape),
rep AS (SELECT dataset, count(*) FILTER (WHERE label = 1) AS pool, count(*) FILTER (WHERE label = 1 AND is_exact) AS exact, count(*) FILTER (WHERE label = 1 AND is_hit) AS rows_hit, count(DISTINCT CASE WHEN is_hit THEN shape END) AS shapes_hit FROM hit GROUP BY dataset),
report AS (SELECT *, coalesce((exact + rows_hit) / nullif(pool, 0), 0) AS share FROM rep)"""


@query(f"WITH {B.LABELLED_SQL}, {_EXACT_SQL} SELECT md5(command) AS digest FROM exact")
def q_label_conflict_exact(spark, d):
    return P.exact_conflicts(B.labelled(spark, d)).select(F.md5("command").alias("digest"))


@query(f"WITH {_CONFLICT_SQL} SELECT dataset, pool, exact, rows_hit, shapes_hit, round(share, 6) AS share, share > 0.05 AS fired FROM report")
def q_label_conflict_shape(spark, d):
    report, _ = P.shape_conflicts(B.labelled(spark, d))
    return report.withColumn("share", F.round("share", 6))


@query(f"""WITH {_CONFLICT_SQL}, bad AS (SELECT command FROM exact UNION SELECT h.command FROM hit h JOIN report r USING (dataset) WHERE is_hit AND r.share > 0.05)
SELECT source, label, count(*) AS n FROM labelled WHERE command NOT IN (SELECT command FROM bad) GROUP BY ALL""")
def q_conflict_antijoin(spark, d):
    rows = B.labelled(spark, d)
    _, drop = P.shape_conflicts(rows)
    return rows.join(drop, "command", "left_anti").groupBy("source", "label").agg(F.count("*").alias("n"))


_SCRUB_SQL = "(?i)" + W.SCRUB.replace(r"\z", "$")
_MARKERS_SQL = "(?i)" + W.MARKERS
_SHELL = "CASE WHEN pos % 3 = 0 THEN command || ' | sh' WHEN pos % 3 = 1 THEN 'wget ' || command || ' | bash' ELSE command END"


@query(f"WITH {B.POOL_SQL}, c AS (SELECT source, {_SHELL} AS command FROM pool) SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(command, '{_SCRUB_SQL}')) AS scrubbed, count(*) FILTER (WHERE regexp_matches(command, '{_MARKERS_SQL}')) AS marked FROM c GROUP BY source")
def q_benign_scrub(spark, d):
    """The normal side's scrub and the report-only markers, over lines with shell tails."""
    c, pos = F.col("command"), F.col("pos")
    rows = B.pool(spark, d).select("source", F.when(pos % 3 == 0, F.concat(c, F.lit(" | sh"))).when(pos % 3 == 1, F.concat(F.lit("wget "), c, F.lit(" | bash"))).otherwise(c).alias("command"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(W.needs_scrub(F.col("command"))).alias("scrubbed"), F.count_if(W.has_marker(F.col("command"))).alias("marked"))


@query(f"WITH {B.SHAPED_SQL}, t AS (SELECT source, shape, count(*) AS n FROM shaped GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_shapes, round(sum(n) / count(*), 6) AS rows_per_shape, max(n) AS max_in_shape FROM t GROUP BY source")
def q_shape_stats(spark, d):
    return P.pool_shapes(B.shaped(spark, d), ["source"], "shape").withColumn("rows_per_shape", F.round("rows_per_shape", 6))


_COUNTS = f"WITH {B.LABELLED_SQL}, c AS (SELECT dataset, label, source, count(*) AS n FROM labelled GROUP BY ALL)"


@query(_COUNTS + """, s AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, label) AS share, count(*) OVER (PARTITION BY dataset, label) AS k, max(n) OVER (PARTITION BY dataset, label) / sum(n) OVER (PARTITION BY dataset, label) AS top FROM c)
SELECT dataset, label, source, n, round(share, 6) AS share, k >= 2 AND top > 0.5 AS warn FROM s""")
def q_concentration(spark, d):
    w = Window.partitionBy("dataset", "label")
    c = B.labelled(spark, d).groupBy("dataset", "label", "source").agg(F.count("*").alias("n"))
    warn = (F.count("*").over(w) >= 2) & (F.max("n").over(w) / F.sum("n").over(w) > DEFAULT.warn_class_share)
    return c.select("dataset", "label", "source", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), warn.alias("warn"))


@query(f"SELECT source, round(avg(regexp_matches(text, '{B.IP_SQL}')::INT), 6) AS share FROM documents GROUP BY source")
def q_ipv4_share(spark, d):
    return readers.table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(F.col("text").rlike(r"(?U)" + B.IP_SQL).cast("int")), 6).alias("share"))


@query(f"WITH {B.LABELLED_SQL} SELECT dataset, label, count(*) AS n, count(DISTINCT shape) AS n_shapes FROM labelled GROUP BY GROUPING SETS ((dataset, label), (dataset), ())")
def q_dataset_summary(spark, d):
    B.labelled(spark, d).createOrReplaceTempView("corpusloom_labelled")
    return spark.sql("SELECT dataset, label, count(*) AS n, count(DISTINCT shape) AS n_shapes FROM corpusloom_labelled GROUP BY GROUPING SETS ((dataset, label), (dataset), ())")


@query(f"""WITH {B.LABELLED_SQL}, s AS (SELECT shape, dataset, min(label) AS lo, max(label) AS hi FROM labelled GROUP BY ALL)
SELECT (SELECT count(*) FROM (SELECT DISTINCT command FROM labelled WHERE dataset = 1 INTERSECT SELECT DISTINCT command FROM labelled WHERE dataset = 2)) AS commands,
(SELECT count(*) FROM s a JOIN s b USING (shape) WHERE a.dataset = 1 AND b.dataset = 2) AS shapes,
(SELECT count(*) FROM s a JOIN s b USING (shape) WHERE a.dataset = 1 AND b.dataset = 2 AND (a.lo <> b.hi OR a.hi <> b.lo)) AS disagree""")
def q_cross_dataset(spark, d):
    rows = B.labelled(spark, d)
    both = rows.groupBy("command").agg(F.count_distinct("dataset").alias("k")).agg(F.count_if(F.col("k") == 2).alias("commands"))
    side = rows.groupBy("shape", "dataset").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    a = side.where("dataset = 1").select("shape", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = side.where("dataset = 2").select("shape", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = a.join(b, "shape").agg(F.count("*").alias("shapes"), F.count_if((F.col("lo1") != F.col("hi2")) | (F.col("hi1") != F.col("lo2"))).alias("disagree"))
    return both.crossJoin(met)  # one row each


@query("SELECT md5(text) AS digest, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text")
def q_fingerprint_sets(spark, d):
    rows = readers.table(spark, d, "documents").groupBy("text").agg(F.sort_array(F.collect_set("lang")).alias("l"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return rows.select(F.md5("text").alias("digest"), F.array_join("l", ",").alias("langs"), "n", "first")


@query("SELECT md5(text) AS digest FROM documents GROUP BY text HAVING list_sort(list(DISTINCT lang)) = ['fr']")
def q_single_fingerprint_only(spark, d):
    rows = readers.table(spark, d, "documents").groupBy("text").agg(F.collect_set("lang").alias("l"))
    return rows.where(F.col("l") == F.array(F.lit("fr"))).select(F.md5("text").alias("digest"))


_SOLO_SQL = W.INNOCUOUS.replace("'", "''")
_WORDS = "(SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'ls -l ' || regexp_extract(text, '[a-z]+', 0) WHEN doc_id % 4 = 1 THEN 'uname -a' WHEN doc_id % 4 = 2 THEN 'ps aux | sh' ELSE text END AS command FROM documents)"


@query(f"""WITH c AS {_WORDS}, h AS (SELECT *, regexp_matches(command, '(?i)^(?:{_SOLO_SQL})\\s*$') AS hit FROM c)
SELECT source, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 4) AS share, coalesce(array_to_string(list_sort(list(DISTINCT command) FILTER (WHERE hit))[1:20], ';'), '') AS examples FROM h GROUP BY source""")
def q_innocuous_rate(spark, d):
    """Whole commands that anyone would call harmless, with the first 20 examples (the top-k is the report)."""
    i = F.col("doc_id") % 4
    c = F.when(i == 0, F.concat(F.lit("ls -l "), F.regexp_extract("text", "[a-z]+", 0))).when(i == 1, "uname -a").when(i == 2, "ps aux | sh").otherwise(F.col("text"))
    rows = readers.table(spark, d, "documents").select("source", c.alias("command")).withColumn("hit", W.innocuous_alone(F.col("command")))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 4).alias("share"))
    few = rows.where("hit").select("source", "command").distinct().withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("command"))).where("k <= 20")
    few = few.groupBy(F.col("source").alias("s")).agg(F.array_join(F.sort_array(F.collect_list("command")), ";").alias("examples"))
    return counts.join(few, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "hits", "share", F.coalesce("examples", F.lit("")).alias("examples"))


_LEVEL = """{p}1 AS (SELECT *, least({need}, sum({most}) OVER ()) AS nd FROM {t}),
{p}2 AS (SELECT a.*, (SELECT coalesce(sum(b.{most}), 0) FROM {p}1 b WHERE b.{most} * a.{w} < a.{most} * b.{w} OR (b.{most} * a.{w} = a.{most} * b.{w} AND b.source < a.source)) AS before,
 (SELECT sum(b.{w}) FROM {p}1 b WHERE NOT (b.{most} * a.{w} < a.{most} * b.{w} OR (b.{most} * a.{w} = a.{most} * b.{w} AND b.source < a.source))) AS heavy FROM {p}1 a),
{p}3 AS (SELECT *, max(CASE WHEN (nd - before) * {w} <= {most} * heavy AND heavy > 0 THEN (nd - before)::DOUBLE / heavy END) OVER () AS level FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN nd <= 0 THEN 0 WHEN level IS NULL OR (nd - before) * {w} > {most} * heavy THEN {most}::DOUBLE ELSE level * {w} END AS part FROM {p}3),
{p}5 AS (SELECT *, floor(round(part, 9)) AS whole, row_number() OVER (ORDER BY round(part, 9) - floor(round(part, 9)) DESC, source) AS turn FROM {p}4),
{p} AS (SELECT *, (whole + CASE WHEN turn <= nd - sum(whole) OVER () AND whole < {most} THEN 1 ELSE 0 END)::BIGINT AS take FROM {p}5)"""


@query(f"""WITH {B.LABELLED_SQL}, c AS (SELECT source, count(*) AS available FROM labelled WHERE label = 0 GROUP BY source),
w AS (SELECT *, (sum(available) OVER () // 2)::BIGINT AS want FROM c), v AS (SELECT *, least(available, greatest(1, floor(want * 0.05)::BIGINT)) AS most FROM w),
{_LEVEL.format(p='one', t='v', need='want', most='most', w='available')},
r AS (SELECT source, available, want, take AS first, want - sum(take) OVER () AS short, available - take AS room FROM one),
{_LEVEL.format(p='two', t='r', need='short', most='room', w='room')}
SELECT source, available, first + take AS take, short > 0 AS breached FROM two""")
def q_allocate(spark, d):
    """Picks per source for half of the normal rows, none above a twentieth; sources are then made to serve beyond it."""
    counts = B.labelled(spark, d).where("label = 0").groupBy("source").agg(F.count("*").alias("available"))
    rows = counts.withColumns({"_all": F.lit(1), "want": F.floor(F.sum("available").over(Window.partitionBy()) / 2)})
    return P.allocated(rows, ["_all"], "source", "want", "available", 0.05).select("source", "available", "take", "breached")


@query()
def q_balance(spark, d):
    """Rows per class and source after balancing; apportionment has its own SQL, the rest goldens in tests."""
    return P.balanced(clean_rows(spark, d)).groupBy("dataset", "label", "source").agg(F.count("*").alias("n"))


def clean_rows(spark, d):
    """Labelled pool rows without conflicts, one per command: the first by source, document and line."""
    rows = B.labelled(spark, d)
    _, drop = P.shape_conflicts(rows)
    return stored(P.keep_first(rows.join(drop, "command", "left_anti"), ["command"], ["source", "doc_id", "pos"]), "clean")


def split_rows(spark, d):
    """Labelled pool rows, one per command, with a leakage-safe split."""
    return stored(P.group_split(clean_rows(spark, d)), "split")


_SPLIT_ROWS_SQL = f"""{_CONFLICT_SQL}, bad AS MATERIALIZED (SELECT command FROM exact UNION SELECT h.command FROM hit h JOIN report r USING (dataset) WHERE is_hit AND r.share > 0.05),
clean AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY source, doc_id, pos) AS k FROM labelled WHERE command NOT IN (SELECT command FROM bad)) WHERE k = 1),
grp AS MATERIALIZED (SELECT dataset, label, shape, count(*) AS n, row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42|split|' || shape), shape) AS k FROM clean GROUP BY dataset, label, shape),
go AS (SELECT dataset, label, 0::BIGINT AS k, round_even(sum(n) * {1 - DEFAULT.train_fraction}::DOUBLE, 0)::BIGINT AS room, false AS taken FROM grp GROUP BY dataset, label
 UNION ALL SELECT go.dataset, go.label, go.k + 1, CASE WHEN grp.n <= room THEN room - grp.n ELSE room END, grp.n <= room FROM go JOIN grp ON grp.dataset = go.dataset AND grp.label = go.label AND grp.k = go.k + 1),
parted AS (SELECT c.*, CASE WHEN go.taken THEN 'test' ELSE 'train' END AS split FROM clean c JOIN grp USING (dataset, label, shape) JOIN go ON go.dataset = grp.dataset AND go.label = grp.label AND go.k = grp.k)"""


@query(f"WITH RECURSIVE {_SPLIT_ROWS_SQL} SELECT dataset, label, split, count(*) AS n, count(DISTINCT shape) AS n_shapes FROM parted GROUP BY ALL")
def q_group_split(spark, d):
    return split_rows(spark, d).groupBy("dataset", "label", "split").agg(F.count("*").alias("n"), F.count_distinct("shape").alias("n_shapes"))


_SPLIT = "CASE WHEN substr(md5('42|h|' || doc_id), 1, 1) < '3' THEN 'test' ELSE 'train' END"


@query(f"""WITH {B.LABELLED_SQL}, s AS (SELECT *, {_SPLIT} AS split FROM labelled), g AS (SELECT label, shape, count(DISTINCT split) AS k FROM s GROUP BY ALL), b AS (SELECT shape FROM s GROUP BY shape HAVING min(label) <> max(label))
SELECT (SELECT count(*) FROM g WHERE k > 1) AS straddling, (SELECT count(*) FROM b) AS both_labels""")
def q_split_straddle(spark, d):
    """Groups on both sides of a row-wise hash split: what the group-aware split avoids."""
    split = F.when(F.substring(P.scoped_hash("h", F.col("doc_id").cast("string")), 1, 1) < "3", "test").otherwise("train")
    rows = B.labelled(spark, d).withColumn("split", split)
    g = rows.groupBy("label", "shape").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("straddling"))
    b = rows.groupBy("shape").agg((F.min("label") != F.max("label")).alias("x")).agg(F.count_if("x").alias("both_labels"))
    return g.crossJoin(b)  # one row each


@query(f"WITH RECURSIVE {_SPLIT_ROWS_SQL} SELECT printf('d%d_%06d', dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|ids|' || command), command) - 1) AS id, command, label, source, split FROM parted")
def q_output_rows(spark, d):
    """The final rows of a build with their seeded ids; checked() fails where an invariant is broken."""
    return P.with_ids(P.checked(split_rows(spark, d))).select("id", "command", "label", "source", "split")
