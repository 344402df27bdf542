"""Queries over files of the extractors' formats, written from the documents and pages that are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.plans import base as B
from corpusloom.plans.catalog import query
from corpusloom.session import shared_path
from corpusloom.sources import parsers, readers, sinks


def _indented(text: str, by: str):
    """A text as the body of a block scalar: a line before it and one after it."""
    return F.concat(F.lit(f"{by}echo start\n{by}"), F.replace(text, F.lit("\n"), F.lit(f"\n{by}")))


@query("""SELECT doc_id::VARCHAR AS path, 'T' || doc_id AS technique, 'linux,' || lang AS platforms, md5('echo start' || chr(10) || text || chr(10) || 'nc ' || source || ':80 #{left}' || chr(10)) AS digest, NULL AS error FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, 'broken' FROM documents WHERE doc_id % 5 = 0""")
def q_technique_files(spark, d):
    """Documents as commands in technique files with arguments; every fifth file is broken."""
    docs = readers.table(spark, d, "documents").where("text is not null")
    head = F.concat(F.lit("---\n# made up\nattack_technique: T"), F.col("doc_id").cast("string"), F.lit("\natomic_tests:\n- name: 'one''s'\n  supported_platforms:\n  - Linux\n  - "), F.upper("lang"), F.lit("\n  input_arguments:\n    host:\n      description: x\n      default: "), F.col("source"), F.lit("\n    port: {default: 80, type: integer}\n  executor:\n    name: bash\n    command: |\n"))
    tail = F.lit("\n      nc #{host}:#{port} #{left}\n- name: two\n  executor: {name: command_prompt, command: dir}\n")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a: [1,\n"), F.lit("b"))).otherwise(F.concat(head, _indented("text", "      "), tail))
    found = parsers.technique_commands(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    command = T.resolve_arguments(F.col("command"), F.col("arguments"))
    return found.select("path", "technique", F.array_join("platforms", ",").alias("platforms"), F.md5(command).alias("digest"), F.when(F.col("error").isNotNull(), "broken").alias("error"))


@query("""SELECT doc_id::VARCHAR AS path, 0 AS pos, md5('echo start' || chr(10) || text || chr(10)) AS digest FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id::VARCHAR, 1, md5(source) FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id::VARCHAR, -1, NULL FROM documents WHERE doc_id % 3 = 2""")
def q_front_matter(spark, d):
    """Documents as code in front matter that ends in either mark; every third file has no functions."""
    docs = readers.table(spark, d, "documents").where("text is not null")
    head = F.lit("---\nfunctions:\n  shell:\n    - description: d\n      code: |\n")
    tail = F.concat(F.lit("\n        \n    - contexts: {sudo: {code: "), F.col("source"), F.lit("}}\nother:\n  code: no\n"), F.when(F.col("doc_id") % 3 == 0, "...\n").otherwise("---\n"))
    content = F.when(F.col("doc_id") % 3 == 2, "---\ncode: x\n").otherwise(F.concat(head, _indented(F.rtrim("text"), "        "), tail))
    found = parsers.front_matter_codes(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return found.select("path", "pos", F.md5("command").alias("digest"))


_PATH = "CASE page_id % 5 WHEN 0 THEN 'linux-hardening/' WHEN 1 THEN './linux-hardening/windows/' WHEN 2 THEN 'crypto/' WHEN 3 THEN 'linux-hardening/powershell-' ELSE 'linux-hardening/deep/' END || page_id || '.md'"

@query(f"""WITH p AS (SELECT page_id, url, {_PATH} AS path, replace(html, '`', '') AS body FROM pages WHERE page_id % 5 IN (0, 4))
SELECT path, 0 AS block, url || ' > Use' AS headings, md5(body) AS digest FROM p UNION ALL SELECT path, 1, 'Other', md5('ls') FROM p WHERE page_id % 3 = 0""")
def q_book_lines(spark, d):
    """Shell fences of a book's subtree under their headings: pages, rendered as a book."""
    lines, _ = parsers.walked(_book(spark, d))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("path", "block", F.array_join("headings", " > ").alias("headings")).agg(F.md5(body).alias("digest"))


@query("""WITH p AS (SELECT page_id % 5 AS k, page_id % 3 AS j FROM pages)
SELECT CASE WHEN k = 2 THEN 'page_offtopic' WHEN k IN (1, 3) THEN 'page_windows' ELSE 'page_walked' END AS kind, count(*) AS n FROM p GROUP BY 1
UNION ALL SELECT * FROM (SELECT unnest(['fence_shell', CASE j WHEN 0 THEN 'fence_shell' WHEN 1 THEN 'fence_windows' ELSE 'fence_other' END]) AS kind, count(*) AS n FROM p WHERE k IN (0, 4) GROUP BY 1)""")
def q_book_counts(spark, d):
    """Pages and fences of that book, walked and left out, by reason."""
    return parsers.walked(_book(spark, d))[1]


def _book(spark, d):
    pages = readers.table(spark, d, "pages")
    i, j = F.col("page_id") % 5, F.col("page_id") % 3
    top = F.when(i == 0, "linux-hardening/").when(i == 1, "./linux-hardening/windows/").when(i == 2, "crypto/").when(i == 3, "linux-hardening/powershell-").otherwise("linux-hardening/deep/")
    lang = F.when(j == 0, "Console").when(j == 1, "ps1").otherwise("python")
    text = F.concat(F.lit("# "), F.col("url"), F.lit("\n## Use\n```bash\n"), F.replace("html", F.lit("`"), F.lit("")), F.lit("\n```\n# Other\n~~~ "), lang, F.lit("\nls\n~~~"))
    return pages.select(F.concat(top, F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


@query(f"""SELECT 'sources' AS section, source AS key, count(*) AS n, round(avg(length(text)), 6) AS value FROM documents GROUP BY source
UNION ALL SELECT 'labels', toxic || '/' || quality, count(*), NULL FROM labels GROUP BY toxic, quality
UNION ALL SELECT 'addresses', lang, count(*) FILTER (WHERE regexp_matches(text, '{B.IP_SQL}')), round(avg(regexp_matches(text, '{B.IP_SQL}')::INT), 6) FROM documents GROUP BY lang""")
def q_stats_document(spark, d):
    """Metric tables as one nested document, written, read back and taken apart."""
    docs, labels = readers.table(spark, d, "documents"), readers.table(spark, d, "labels")
    ip = F.col("text").rlike("(?U)" + T.IPV4)
    document = sinks.stats_document({
        "sources": docs.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("value")),
        "labels": labels.groupBy(F.concat_ws("/", "toxic", "quality").alias("key")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("value")),
        "addresses": docs.groupBy(F.col("lang").alias("key")).agg(F.count_if(ip).alias("n"), F.round(F.avg(ip.cast("int")), 6).alias("value")),
    })
    path = shared_path(spark, "stats")
    sinks.write_document(document, path)
    back = sinks.read_document(spark, path, document.schema)
    out = None
    for name in back.columns:
        one = back.select(F.lit(name).alias("section"), F.inline(name))
        out = one if out is None else out.unionByName(one)
    return out


_OS = "CASE page_id % 4 WHEN 0 THEN ['linux'] WHEN 1 THEN ['macos'] WHEN 2 THEN ['linux', 'macos'] END"
_SAID = "CASE WHEN page_id % 6 = 0 THEN 'echo done' ELSE 'curl ' || url END"


@query(f"""WITH r AS (SELECT {_OS} AS p, {_SAID} AS c, page_id % 6 = 0 AS e FROM pages)
SELECT 'all' AS subset, count(DISTINCT c) AS n FROM r UNION ALL SELECT 'no_status_echo', count(DISTINCT c) FROM r WHERE NOT e
UNION ALL SELECT 'linux', count(DISTINCT c) FROM r WHERE NOT e AND (p IS NULL OR list_contains(p, 'linux')) UNION ALL SELECT 'macos_only', count(DISTINCT c) FROM r WHERE NOT e AND p = ['macos']""")
def q_platform_subsets(spark, d):
    """Distinct commands by the platforms that a technique names, with and without echoes of a status."""
    i = F.col("page_id") % 4
    names = F.when(i == 0, F.array(F.lit("linux"))).when(i == 1, F.array(F.lit("macos"))).when(i == 2, F.array(F.lit("linux"), F.lit("macos")))
    said = F.when(F.col("page_id") % 6 == 0, "echo done").otherwise(F.concat(F.lit("curl "), "url"))
    rows = readers.table(spark, d, "pages").select(names.alias("platforms"), said.alias("line"))
    return parsers.platform_subsets(R.passed(rows, R.TECHNIQUE, "line"))
