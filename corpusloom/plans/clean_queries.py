"""Queries over the cleaning of scraped command text, and whole fingerprints of made-up commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import shape as shapes
from corpusloom.functions import text as T
from corpusloom.functions import wellformed as W
from corpusloom.plans import base as B
from corpusloom.plans.catalog import query
from corpusloom.sources import parsers, readers

_ODD = """(CASE WHEN doc_id % 4 = 0 THEN 'sudo -u x env A1=2 B=c ' || w[1] || ' XKCD9 7z9qk3bb' WHEN doc_id % 4 = 1 THEN 'export -n ' || w[1] || '=1 env unset ' || w[2] || ' Q; timeout 5 -k ' || w[3] || ' qwrtpsd'
 WHEN doc_id % 4 = 2 THEN 'declare ' || w[1] || ' if ! xargs nice /bin/sudo 12 ' || w[2] || '|read -r ' || w[3] || '&&for ' || w[4] || ' in $(x)' ELSE 'x=' || w[1] || ' ' || w[2] || '+=3 V=1 aGVsbG8gd29ybGQh1234567== deadbeef99 /tmp/' || w[3] || ' `' || w[4] || '`' END)"""


@query(f"""WITH pool AS (SELECT doc_id, 0 AS pos, 's' AS source, {_ODD} AS command FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) WHERE len(w) > 3),
{B.SHAPE_SQL.replace('{no_rule}', 'true')} SELECT doc_id, shape FROM shapes""")
def q_shape_tokens(spark, d):
    """Whole fingerprints of command lines with prefixes, wrappers, bindings and blobs around a document's words."""
    i, w = F.col("doc_id") % 4, [F.get("w", F.lit(k)) for k in range(4)]
    docs = readers.table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) > 3")
    odd = F.when(i == 0, F.concat(F.lit("sudo -u x env A1=2 B=c "), w[0], F.lit(" XKCD9 7z9qk3bb")))
    odd = odd.when(i == 1, F.concat(F.lit("export -n "), w[0], F.lit("=1 env unset "), w[1], F.lit(" Q; timeout 5 -k "), w[2], F.lit(" qwrtpsd")))
    odd = odd.when(i == 2, F.concat(F.lit("declare "), w[0], F.lit(" if ! xargs nice /bin/sudo 12 "), w[1], F.lit("|read -r "), w[2], F.lit("&&for "), w[3], F.lit(" in $(x)")))
    odd = odd.otherwise(F.concat(F.lit("x="), w[0], F.lit(" "), w[1], F.lit("+=3 V=1 aGVsbG8gd29ybGQh1234567== deadbeef99 /tmp/"), w[2], F.lit(" `"), w[3], F.lit("`")))
    return docs.select("doc_id", shapes.shape(odd).alias("shape"))


_MARKED = "(SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  me@box.x:~/a$ ' WHEN 1 THEN ' $ ' WHEN 2 THEN '> ' WHEN 3 THEN '$x ' WHEN 4 THEN 'me@box:~$ # ' WHEN 5 THEN 'me@box:/a b $ c# ' ELSE '' END || text AS t FROM documents)"
_PROMPT_SQL = "t"
for _p in T.PROMPTS:
    _PROMPT_SQL = f"regexp_replace({_PROMPT_SQL}, '{_p}', '')"


@query(f"SELECT doc_id, md5({_PROMPT_SQL}) AS digest FROM {_MARKED}")
def q_strip_prompt(spark, d):
    """Documents behind prompts of several kinds, one in another."""
    i = F.col("doc_id") % 7
    mark = F.when(i == 0, "  me@box.x:~/a$ ").when(i == 1, " $ ").when(i == 2, "> ").when(i == 3, "$x ").when(i == 4, "me@box:~$ # ").when(i == 5, "me@box:/a b $ c# ").otherwise("")
    return readers.table(spark, d, "documents").select("doc_id", F.md5(T.strip_prompt(F.concat(mark, "text"))).alias("digest"))


@query(r"""WITH c AS (SELECT doc_id, replace(replace(text, ',', ' "'), '.', ' #') AS t FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|[ \t]+#?|[^"'' \t]+') AS a FROM c),
x AS (SELECT doc_id, t, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM k),
m AS (SELECT doc_id, i, p, t, min(CASE WHEN regexp_matches(p, '^[ \t]+#$') THEN i END) OVER (PARTITION BY doc_id) AS cut_at FROM x)
SELECT doc_id, md5(CASE WHEN max(cut_at) IS NULL THEN max(t) ELSE regexp_replace(coalesce(string_agg(p, '' ORDER BY i) FILTER (WHERE i < cut_at), ''), '\s+$', '') END) AS digest FROM m GROUP BY doc_id""")
def q_strip_comment(spark, d):
    """Whole documents in which commas open quotes and full stops begin comments."""
    c = F.replace(F.replace("text", F.lit(","), F.lit(' "')), F.lit("."), F.lit(" #"))
    return readers.table(spark, d, "documents").select("doc_id", F.md5(T.strip_comment(c)).alias("digest"))


_CUT_SQL = "replace(replace(text, ',', chr(92) || chr(10)), '.', chr(10) || chr(92) || chr(10))"


@query(rf"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split({_CUT_SQL}, chr(10)) AS a FROM documents)),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, '' AS held, NULL::VARCHAR AS line FROM l
 UNION ALL SELECT doc_id, i + 1, CASE WHEN more THEN regexp_replace(substr(e, 1, length(e) - 1), '\s+$', '') ELSE '' END, CASE WHEN NOT more THEN s END FROM
 (SELECT *, length(regexp_extract(e, '(\\*)$', 1)) % 2 = 1 AS more FROM (SELECT *, regexp_replace(s, '\s+$', '') AS e FROM
 (SELECT f.doc_id, f.i, CASE WHEN f.held <> '' THEN f.held || ' ' || regexp_replace(l.x, '^\s+|\s+$', '', 'g') ELSE l.x END AS s FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)))),
a AS (SELECT doc_id, line, i FROM f WHERE line IS NOT NULL UNION ALL SELECT doc_id, arg_max(held, i), max(i) + 1 FROM f GROUP BY doc_id HAVING arg_max(held, i) <> '')
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM a GROUP BY doc_id""")
def q_continuations(spark, d):
    """Documents whose commas became backslashes at line ends, and full stops lines of a backslash alone, joined again."""
    text = F.replace(F.replace("text", F.lit(","), F.lit("\\\n")), F.lit("."), F.lit("\n\\\n"))
    joined = readers.table(spark, d, "documents").select("doc_id", T.join_continuations(text).alias("t"))
    return joined.select("doc_id", F.size(F.split("t", "\n")).cast("long").alias("n"), F.md5("t").alias("digest"))


_RULES = [("[0-9]+", "N"), (r"\bthe\b", "THE"), ("N N", "NN")]


@query(r"""WITH s AS (SELECT source, text, regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', 'N', 'g'), '\bthe\b', 'THE', 'g'), 'N N', 'NN', 'g') AS t FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE t <> text) AS changed, sum(length(t))::BIGINT AS chars FROM s GROUP BY source""")
def q_substitutions(spark, d):
    """A list of substitutions, with the number of texts that it changed."""
    out, changed = T.substituted(F.col("text"), _RULES)
    rows = readers.table(spark, d, "documents").select("source", out.alias("t"), changed.alias("changed"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.sum(F.length("t")).cast("long").alias("chars"))


@query("SELECT page_id, 'bash' AS lang, len(string_split(t, chr(10))) AS n_lines, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS t FROM pages)")
def q_fences(spark, d):
    """Fenced blocks of pages, read from a Markdown rendering of their paragraphs."""
    pages = readers.table(spark, d, "pages").select("page_id", F.concat(F.lit("intro\n```bash\n"), F.regexp_replace("html", "<[^>]*>", "\n"), F.lit("\n```\n")).alias("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return parsers.blocks(pages, "page_id").groupBy("page_id", "lang").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
b AS (SELECT doc_id, 'cat <<-''END'' ' || string_agg(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' ' ORDER BY i) || ' END' AS c FROM l GROUP BY doc_id)
SELECT doc_id, 3 AS n_commands, md5('grep x <<<END' || chr(10) || c || chr(10) || 'ls') AS digest FROM b""".replace("\\", chr(92)))
def q_heredoc(spark, d):
    """Documents behind a here-document opener, one command each when bodies are merged; a here-string has no body."""
    docs = readers.table(spark, d, "documents").select("doc_id", F.concat(F.lit("grep x <<<END\ncat <<-'END'\n"), "text", F.lit("\n\t END \nls")).alias("text"))
    commands = F.transform(F.sort_array(F.collect_list(F.struct("pos", "command"))), lambda x: x["command"])
    return parsers.merged_heredocs(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_commands"), F.md5(F.array_join(commands, "\n")).alias("digest"))


_URLED = "'get ' || url || ' http://10.0.' || page_id % 256 || '.7:80/x ftp://u@10.1.2.3/ HTTPS://Www.X.org 10.1.2.3'"


@query(f"SELECT page_id, {B.normalize_sql('(' + _URLED + ')')} AS command FROM pages")
def q_normalize_urls(spark, d):
    """Addresses inside urls and beside them: hosts are hashed first."""
    raw = F.concat(F.lit("get "), F.col("url"), F.lit(" http://10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7:80/x ftp://u@10.1.2.3/ HTTPS://Www.X.org 10.1.2.3"))
    return readers.table(spark, d, "pages").select("page_id", T.normalize(raw).alias("command"))


_WIDE = ["é\u00a0= x", "classé a:", "class\u00a0a:", "<a\u00a0b='c'>", "\"k\"\u00a0: 1", "@été x:", "with é; y:", "Über uns:"]
_BROKEN = ", ".join(f"({x})::INT" for x in B.RULES_SQL.values())


@query(f"""WITH c AS (SELECT doc_id, {'[' + ', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in _WIDE) + ']'}[doc_id % {len(_WIDE)} + 1] AS command FROM documents), r AS (SELECT doc_id, command, command AS raw FROM c)
SELECT doc_id, array_to_string([{_BROKEN}], '') AS broken FROM r""")
def q_wf_wide(spark, d):
    """The rules over lines with a no-break space and letters beyond ASCII."""
    line = F.element_at(F.array(*map(F.lit, _WIDE)), (F.col("doc_id") % len(_WIDE) + 1).cast("int"))
    rows = readers.table(spark, d, "documents").select("doc_id", line.alias("command"), line.alias("raw"))
    flags = F.array(*[F.array_contains("violations", name).cast("int").cast("string") for name in W.RULES])
    return W.well_formed(rows).select("doc_id", F.array_join(flags, "").alias("broken"))
