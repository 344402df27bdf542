"""Parsers of semi-structured text as table functions: fences, here-documents, YAML."""

from __future__ import annotations

import bisect
import contextlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored
from corpusloom.sources import yamlish

# Fixed value: what opens a here-document.
OPENER = re.compile(r"<<-?\s*[\"']?([A-Za-z_][A-Za-z0-9_]*)[\"']?")


# Fence languages, and the parts of a book's tree that are walked.
SHELLS = frozenset(["bash", "sh", "shell", "shell-session", "sh-session", "bash-session", "console", "zsh", "shellsession"])
WINDOWS = frozenset(["powershell", "posh", "ps", "ps1", "pwsh", "cmd", "bat", "batch", "dosbatch", "dos"])
SUBTREES = ("linux-hardening/",)
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def sections(text: str) -> Iterator[tuple[list[str], str, list[str]]]:
    """(headings, language, lines) of each fenced block; headings are those it stands under, outermost first.

    A fence closes at three or more of its marks alone; an open one runs to the end. A heading
    drops those of its own level and deeper from the stack.
    """
    stack: list[tuple[int, str]] = []
    mark, lang, body = "", "", []
    for line in text.split("\n"):
        bare = line.strip()
        if mark:
            if bare.startswith(mark * 3) and not bare.lstrip(mark):
                yield [h for _, h in stack], lang, body
                mark = ""
            else:
                body.append(line)
        elif bare.startswith(("```", "~~~")):
            words = bare.lstrip("`~").split()
            mark, lang, body = bare[0], words[0].lower() if words else "", []
        elif found := HEADING.match(line):
            level = len(found[1])
            stack = [x for x in stack if x[0] < level] + [(level, found[2] or "")]
    if mark:
        yield [h for _, h in stack], lang, body


def fenced_blocks(text: str) -> Iterator[tuple[str, list[str]]]:
    """(language, lines) of each fenced block."""
    for _, lang, body in sections(text):
        yield lang, body


def page_reason(path: Column, subtrees: tuple[str, ...] = SUBTREES) -> Column:
    """Why a page of a book is not walked, by its path alone: off the subtrees, or another system's; null if it is."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), r"^[./]+", "")
    inside = F.lit(False)
    for tree in subtrees:
        inside = inside | F.startswith(p, F.lit(tree))
    other = F.lower(p).rlike(r"(?:^|/)windows-hardening/|(?:^|/)windows/|(?:^|/)powershell[^/]*$")
    return F.when(~F.coalesce(inside, F.lit(False)), "offtopic").when(other, "windows")


def fence_kind(lang: Column) -> Column:
    """shell, windows, none or other."""
    return F.when(lang.isin(sorted(SHELLS)), "shell").when(lang.isin(sorted(WINDOWS)), "windows").when(lang == "", "none").otherwise("other")


def heredocs(lines: list[str], policy: str = "merge") -> list[str]:
    """Here-documents in a list of lines: ``merge`` into one line, ``drop`` the body, or ``reject`` the command.

    A body ends at a line that is the marker but for blanks around it, or with the text; a
    here-string (``<<<``) has none. Merged lines lose the blanks around them and are joined
    by one space.
    """
    ends: dict[str, list[int]] = {}
    for n, line in enumerate(lines):
        ends.setdefault(line.strip(), []).append(n)
    out, at = [], 0
    while at < len(lines):
        found = None if "<<<" in lines[at] else OPENER.search(lines[at])
        after = at + 1
        if found:
            closing = ends.get(found[1], [])
            k = bisect.bisect_left(closing, after)
            after = closing[k] + 1 if k < len(closing) else len(lines)
        if not found or policy == "drop":
            out.append(lines[at])
        elif policy == "merge":
            out.append(" ".join(x.strip() for x in lines[at:after]))
        at = after
    return out


def yaml_codes(node: object) -> Iterator[str]:
    """Every ``code`` string at any depth of a parsed document."""
    if isinstance(node, dict):
        for k, v in node.items():
            if k == "code" and isinstance(v, str):
                yield v
            else:
                yield from yaml_codes(v)
    elif isinstance(node, list):
        for v in node:
            yield from yaml_codes(v)


def blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block, headings, lang, pos, line) of fenced blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, under, lang, p, line) for k, t in zip(b["k"], b["t"], strict=True) for n, (under, lang, body) in enumerate(sections(t or "")) for p, line in enumerate(body)]
            yield pd.DataFrame(rows, columns=["k", "block", "headings", "lang", "pos", "line"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, block int, headings array<string>, lang string, pos int, line string")
    return out.withColumnRenamed("k", key)


def walked(pages: DataFrame, path: str = "path", text: str = "text", subtrees: tuple[str, ...] = SUBTREES) -> tuple[DataFrame, DataFrame]:
    """The shell lines of a book (path, block, headings, lang, pos, line), and (kind, n): pages and fences (that hold lines) taken and left out, by reason."""
    decided = pages.select(F.col(path).alias("path"), F.col(text).alias("text"), page_reason(F.col(path), subtrees).alias("reason"))
    counts = decided.groupBy(F.concat(F.lit("page_"), F.coalesce("reason", F.lit("walked"))).alias("kind")).agg(F.count("*").alias("n"))
    found = stored(blocks(decided.where("reason is null"), "path"), "fences")
    fences = found.select("path", "block", "lang").distinct().groupBy(F.concat(F.lit("fence_"), fence_kind(F.col("lang"))).alias("kind")).agg(F.count("*").alias("n"))
    return found.where(fence_kind(F.col("lang")) == "shell"), counts.unionByName(fences)


def merged_heredocs(df: DataFrame, key: str, text: str = "text", policy: str = "merge") -> DataFrame:
    """(key, pos, command) of a text's lines with here-documents treated by policy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p, c) for k, t in zip(b["k"], b["t"], strict=True) for p, c in enumerate(heredocs((t or "").split("\n"), policy))]
            yield pd.DataFrame(rows, columns=["k", "pos", "command"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, pos int, command string").withColumnRenamed("k", key)


def technique_tests(text: str | None, shells: tuple[str, ...]) -> Iterator[tuple]:
    """(technique, name, platforms, command, arguments) of a file's tests whose executor is a shell."""
    doc = yamlish.load(text or "")
    if not isinstance(doc, dict):
        return
    for test in doc.get("atomic_tests") or []:
        executor = test.get("executor") or {}
        command = executor.get("command")
        if executor.get("name") in shells and isinstance(command, str) and command.strip():
            arguments = {str(k): str(v["default"]) for k, v in (test.get("input_arguments") or {}).items() if isinstance(v, dict) and v.get("default") is not None}
            yield doc.get("attack_technique"), test.get("name"), [str(x).lower() for x in test.get("supported_platforms") or []], command, arguments


def technique_commands(files: DataFrame, shells: tuple[str, ...] = ("bash", "sh")) -> DataFrame:
    """(path, technique, name, platforms, command, arguments, error) of technique files (path, content).

    A file that cannot be read gives one row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *found, None) for found in technique_tests(content, shells)]
                except (yamlish.YamlError, AttributeError, TypeError) as e:  # a map or list where the other was expected
                    rows.append((path, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "technique", "name", "platforms", "command", "arguments", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, technique string, name string, platforms array<string>, command string, arguments map<string, string>, error string")


def functions_of(text: str) -> dict | None:
    """The ``functions`` map of front matter; stray marks before or after it are taken off if it cannot be read with them."""
    doc = None
    with contextlib.suppress(yamlish.YamlError):
        doc = yamlish.load(text)
    if not isinstance(doc, dict):
        body = text.removeprefix("---")
        end = re.search(r"\n(?:\.\.\.|---)\s*$", body)
        with contextlib.suppress(yamlish.YamlError):
            doc = yamlish.load(body[: end.start()] if end else body)
    functions = doc.get("functions") if isinstance(doc, dict) else None
    return functions if isinstance(functions, dict) else None


def front_matter_codes(files: DataFrame) -> DataFrame:
    """(path, pos, command) of every ``code`` text at any depth under ``functions`` in front matter; pos -1 and no command for a file without."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                functions = functions_of(content or "")
                rows += [(path, -1, None)] if functions is None else [(path, k, c) for k, c in enumerate(yaml_codes(functions))]
            yield pd.DataFrame(rows, columns=["path", "pos", "command"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, command string")


def platform_subsets(lines: DataFrame, bank_reason: str = "reason") -> DataFrame:
    """(subset, n): distinct kept commands of technique files in all, without status echoes, for Linux (or containers, or no platform named), and for macOS alone.

    ``lines`` has platforms, clean and the reason that the technique bank gives; an echo of a status is kept in the first subset only.
    """
    reason, p = F.col(bank_reason), F.coalesce("platforms", F.array().cast("array<string>"))
    echo = reason.eqNullSafe(F.lit("status_echo"))
    rows = lines.where(reason.isNull() | echo)
    linux = F.array_contains(p, "linux") | F.array_contains(p, "containers") | (F.size(p) == 0)
    subsets = {"all": F.lit(True), "no_status_echo": ~echo, "linux": ~echo & linux, "macos_only": ~echo & (p == F.array(F.lit("macos")))}
    told = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    counts = rows.select("clean", F.explode(told).alias("subset")).groupBy("subset").agg(F.count_distinct("clean").alias("n"))
    names = lines.sparkSession.createDataFrame([(n,) for n in subsets], "subset string")
    return names.join(counts, "subset", "left").select("subset", F.coalesce("n", F.lit(0)).alias("n"))
