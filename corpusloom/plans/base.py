"""The shared tables of the queries, and the SQL that says the same.

The fixtures stand in for the engine's inputs: lines of ``documents`` for command lines,
``source`` for the source, language for the dataset, ``labels.toxic`` for the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import shape as shapes
from corpusloom.functions import text as T
from corpusloom.functions import wellformed as W
from corpusloom.functions.wellformed import well_formed
from corpusloom.session import stored
from corpusloom.sources.readers import first_of_equals, lines_of, table

IP_SQL = T.IPV4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("dataset", F.when(F.col("lang") == "en", 1).otherwise(2))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(documents(spark, sf_dir), "text", ["doc_id", "source", "dataset"])


def _firsts(spark: SparkSession, sf_dir: str, narrow: bool = False) -> DataFrame:
    """Normalised, usable lines, the first of equals per source.

    Documents are dealt anew first: a file of few row groups would leave the patterns to few tasks.
    """
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = documents(spark, sf_dir).repartition(tasks, "doc_id")
    return first_of_equals(lines_of(docs, "text", ["doc_id", "source", "dataset"]), ["source"], ["doc_id", "pos"], narrow)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These with violated rules."""
    return well_formed(_firsts(spark, sf_dir))


def _shaped(rows: DataFrame, name: str) -> DataFrame:
    """Well-formed rows with their fingerprint, written once for the plans that read it several times; a row holds its line once, as the command."""
    return stored(well_formed(rows).where("size(violations) = 0").drop("raw", "violations").withColumn("shape", shapes.shape(F.col("command"))), name)


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed pool rows with their fingerprint."""
    return _shaped(_firsts(spark, sf_dir, narrow=True), "shaped")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such rows of labelled documents; of the others, rules and fingerprint are not asked."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _shaped(_firsts(spark, sf_dir, narrow=True).join(labels, "doc_id"), "labelled")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the scores of fixed rules: a length score and an address rule."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    docs = documents(spark, sf_dir).join(labels, "doc_id")
    n = F.length("text").cast("double")
    return docs.withColumns({"score": n / (n + 1500), "has_ip": F.col("text").rlike(r"(?U)" + IP_SQL)})


def byte_sql(h: str, k: int) -> str:
    return f"('0x' || substr({h}, {2 * k + 1}, 2))::INT"


def fake_ip_sql(ip: str) -> str:
    h = f"sha1({ip})"
    return f"(({byte_sql(h, 0)} % 223 + 1)::VARCHAR || '.' || {byte_sql(h, 1)} || '.' || {byte_sql(h, 2)} || '.' || ({byte_sql(h, 3)} % 254 + 1))"


def replace_each_sql(x: str, pattern: str, change: str) -> str:
    """``change`` is written over m, the match."""
    p = pattern.replace("'", "''")
    parts, found = f"string_split_regex({x}, '{p}')", f"regexp_extract_all({x}, '{p}')"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN array_to_string(list_transform(list_zip({parts}, list_transform({found}, lambda m: {change})), lambda z: z[1] || coalesce(z[2], '')), '') ELSE {x} END"


def normalize_sql(raw: str) -> str:
    quoted = "'" + "''''" + '""' + "''''" + "'"
    t = f"translate(regexp_replace(translate({raw}, '‘’“”´′', {quoted}), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), chr(13) || chr(10) || chr(9), '   ')"
    host = "regexp_extract(m, '^[^:]*://', 0) || 'h' || substr(sha1(lower(regexp_replace(m, '^[^:]*://', ''))), 1, 8) || '.example.net'"
    return f"trim(regexp_replace({replace_each_sql(replace_each_sql(t, '(?i)' + T.URL_HOST, host), IP_SQL, fake_ip_sql('m'))}, '\\s+', ' ', 'g'))"


QUOTED_SQL = "\"[^\"]*\"|''[^'']*''"
CORE_SQL = f"regexp_replace(regexp_replace(regexp_replace(command, '{QUOTED_SQL}', 'Q', 'g'), '\\b[0-9a-fA-F]{{8,}}\\b', 'H', 'g'), '\\b\\d+\\b', 'N', 'g')"


def _rule_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{wide_sql(pattern)}')"


def wide_sql(pattern: str) -> str:
    """A rule's pattern in a dialect whose classes know ASCII alone: letters, digits and blanks of all scripts spelt out."""
    for a, b in (("'", "''"), (r"\b[^;]*:\z", r"(?:[^;\p{L}\p{N}_][^;]*)?:\z"), (r"\w", r"[\p{L}\p{N}_]"), (r"\s", r"[\s\p{Z}]"), (r"\z", "$")):
        pattern = pattern.replace(a, b)
    return pattern


UNTERMINATED_SQL = f"regexp_matches(regexp_replace(command, '{QUOTED_SQL}', '', 'g'), '[''\"]')"
RULES_SQL = {
    "W1_unterminated_quote": UNTERMINATED_SQL,
    "W2_terminal_control": f"({_rule_sql('raw', W.TERMINAL)} OR {_rule_sql('command', W.CARET)})",
    "W3_spaced_assignment": _rule_sql("command", W.SPACED_ASSIGNMENT),
    "W4_json_member": _rule_sql("command", W.JSON_MEMBER),
    "W5_markup_tag": _rule_sql("command", W.MARKUP),
    "W6_block_colon": _rule_sql("command", W.BLOCK),
    "W7_no_word_char": f"NOT {_rule_sql('command', W.WORD)}",
    "W8_prompt_phrase": _rule_sql("command", W.PROMPT),
}
_NO_RULE = " AND ".join(f"NOT ({x})" for x in RULES_SQL.values())
LINES_SQL = "lines AS (SELECT doc_id, source, dataset, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS dataset, string_split(text, chr(10)) AS a FROM documents))"
NORM_SQL = f"{LINES_SQL}, norm AS MATERIALIZED (SELECT *, {normalize_sql('raw')} AS command FROM lines)"
USABLE_SQL = "(length(command) BETWEEN 2 AND 4096 AND NOT starts_with(ltrim(command), '#'))"
POOL_SQL = f"{NORM_SQL}, pool AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, command ORDER BY doc_id, pos) AS rn FROM norm WHERE {USABLE_SQL}) WHERE rn = 1)"
# the fingerprint in sets: tokens as rows, windows over the tokens of a segment. Letters beyond ASCII stand between
# underscores meanwhile, so that a boundary means the same as in a dialect that knows them as letters.
_NAMED = "(?:[A-Za-z0-9_]{2,}|[0-9AC-GI-MO-PS-UW-Za-z_])"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"
_WIDE = "[À-ÖØ-öø-ɏ]"
_TEXT_SQL = f"regexp_replace(regexp_replace(command, '{QUOTED_SQL}', 'Q', 'g'), '({_WIDE})', '_\\1_', 'g')"
_BLOB_SQL = replace_each_sql("x", shapes.BLOB, "CASE WHEN regexp_matches(m, '[0-9]') OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')) THEN 'B' ELSE m END")
_LATER_SQL = "x"
for _pattern, _into in (
    (shapes.HEX, "H"),
    (r"(^|[^A-Za-z0-9_./~-])((?:~|/tmp|/var/tmp|/var/www|/dev/shm|/run/shm|/root|/home/[A-Za-z0-9_.-]+)/)[A-Za-z0-9_-]+", r"\1\2R"),
    (rf"\bfor\s+{_NAMED}\s+in\b", "for V in"),
    (rf"\b(read)((?:\s+-[A-Za-z0-9]+)*)\s+{_NAMED}", r"\1\2 V"),
    (shapes.EXPAND_BRACE, r"${\1V"),
    (shapes.EXPAND, "$V"),
    (shapes.SEPARATOR, chr(0xE000) + r"\1" + chr(0xE000)),
):
    _LATER_SQL = f"regexp_replace({_LATER_SQL}, '{_pattern}', '{_into}', 'g')"
_RANDOM_SQL = """((length(m) >= 4 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '^[A-Z0-9]+$')) OR (length(m) >= 6 AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '[aeiouyAEIOUY]'))
 OR (regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND (length(m) >= 8 OR (length(m) >= 6 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND len(regexp_extract_all(m, '[0-9]+|[A-Z]+|[a-z]+')) >= 4))))"""
_BLANK_SQL = replace_each_sql("t", "[A-Za-z0-9]{4,}", f"CASE WHEN {_RANDOM_SQL} THEN 'R' ELSE m END")
_FREE = f"NOT IN {_IN(shapes.PLACEHOLDERS)}"
SHAPE_SQL = f"""sh1 AS (SELECT *, {_TEXT_SQL} AS x FROM pool WHERE {{no_rule}}), sh2 AS (SELECT * EXCLUDE (x), {_BLOB_SQL} AS x FROM sh1),
sh3 AS (SELECT doc_id, pos, source, regexp_extract_all({_LATER_SQL}, '{chr(0xE000)}[^{chr(0xE000)}]*{chr(0xE000)}|[^\\s{chr(0xE000)}]+') AS a FROM sh2),
sh4 AS (SELECT doc_id, pos, source, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM sh3),
sh5 AS (SELECT doc_id, pos, source, i, starts_with(raw, chr(57344)) AS sep, replace(raw, chr(57344), '') AS t FROM sh4),
sh6 AS (SELECT *, {_BLANK_SQL} AS blank, CASE WHEN t IN {_IN(shapes.NAMERS)} THEN 2 WHEN t IN {_IN(shapes.ASSIGNERS)} THEN 1 END AS kw, regexp_extract(t, '^([A-Za-z0-9_]+)\\+?=', 1) AS nm,
 sum(sep::INT) OVER (PARTITION BY source, doc_id, pos ORDER BY i) AS seg FROM sh5),
sh7 AS (SELECT *, max(CASE WHEN kw IS NOT NULL THEN i * 4 + kw END) OVER (PARTITION BY source, doc_id, pos, seg, sep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 4 AS last FROM sh6),
sh8 AS (SELECT *, starts_with(t, '-') AND last IS NOT NULL AND kw IS NULL AS flagged, nm <> '' AS assigns, last = 2 AND regexp_matches(t, '^[A-Za-z0-9_]+$') AND t {_FREE} AS bare FROM sh7),
sh9 AS (SELECT *, min(CASE WHEN NOT (kw IS NOT NULL OR flagged OR assigns OR coalesce(bare, false)) THEN i END) OVER (PARTITION BY source, doc_id, pos, seg, sep) AS cmd FROM sh8),
sh10 AS (SELECT *, i = cmd OR (i > cmd AND NOT starts_with(t, '-') AND NOT regexp_matches(t, '^[0-9]+$')) AS chain FROM sh9),
sh11 AS (SELECT *, coalesce(sum(CASE WHEN chain AND regexp_extract(t, '[^/]*$', 0) NOT IN {_IN(shapes.WRAPPERS)} THEN 1 ELSE 0 END) OVER (PARTITION BY source, doc_id, pos, seg, sep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
 lag(sep) OVER (PARTITION BY source, doc_id, pos ORDER BY i) AS after FROM sh10),
sh12 AS (SELECT *, CASE WHEN sep OR (chain AND ended = 0) THEN t WHEN i < coalesce(cmd, i + 1) AND kw IS NULL AND NOT flagged AND assigns AND nm {_FREE} THEN regexp_replace(blank, '^[A-Za-z0-9_]+(\\+?=)', 'V\\1') WHEN i < coalesce(cmd, i + 1) AND kw IS NULL AND NOT flagged AND NOT assigns AND bare THEN 'V' ELSE blank END AS shown FROM sh11),
sh13 AS (SELECT source, doc_id, pos, string_agg(CASE WHEN NOT sep AND after = false THEN ' ' ELSE '' END || shown, '' ORDER BY i) AS y FROM sh12 GROUP BY ALL),
shapes AS (SELECT source, doc_id, pos, regexp_replace(regexp_replace(y, '\\b\\d+\\b', 'N', 'g'), '_({_WIDE})_', '\\1', 'g') AS shape FROM sh13)"""
SHAPED_SQL = f"{POOL_SQL}, {SHAPE_SQL.replace('{no_rule}', _NO_RULE)}, shaped AS MATERIALIZED (SELECT p.*, coalesce(s.shape, '') AS shape FROM (SELECT * FROM pool WHERE {_NO_RULE}) p LEFT JOIN shapes s USING (source, doc_id, pos))"
LABELLED_SQL = f"{SHAPED_SQL}, labelled AS MATERIALIZED (SELECT s.*, l.toxic AS label FROM shaped s JOIN labels l USING (doc_id))"
SCORED_SQL = f"scored AS (SELECT d.*, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS dataset, l.toxic AS label, l.quality, length(text)::DOUBLE / (length(text)::DOUBLE + 1500) AS score, regexp_matches(text, '{IP_SQL}') AS has_ip FROM documents d JOIN labels l USING (doc_id))"
