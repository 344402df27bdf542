"""Sinks: partitioned tables, split files, line files, JSON and Markdown reports."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_splits(df: DataFrame, path: str, kind: str = "csv") -> None:
    """(id, command, label, source, split) by dataset and split; one shuffle deals each pair to its own files."""
    rows = df.select("id", "command", "label", "source", "dataset", "split").repartition("dataset", "split").sortWithinPartitions("dataset", "split", "id")
    writer = rows.write.mode("overwrite").partitionBy("dataset", "split")
    (writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.format(kind).save(path))


def write_lines(df: DataFrame, path: str, column: str = "command") -> None:
    """One command per line."""
    df.select(column).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stats_document(sections: dict[str, DataFrame]) -> DataFrame:
    """Small metric tables as one nested row: a sorted array of rows for each section. Nothing is collected to build it."""
    out = None
    for name, df in sections.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def write_document(document: DataFrame, path: str) -> None:
    """The nested row as a JSON file; nulls are kept as such."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written document; an error if it does not have one row of the given form."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.count() != 1:
        raise ValueError(f"{path} does not hold one document")
    return df


def same_document(a: DataFrame, b: DataFrame) -> bool:
    """Whether two documents say the same."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def card(title: str, document: DataFrame, headings: dict[str, str]) -> str:
    """A data card: a table for each named section of a document, with its heading, from the one row that is read."""
    row = document.first()
    parts = [f"# {title}"]
    for name, heading in headings.items():
        rows = row[name] or []
        columns = document.schema[name].dataType.elementType.names
        cells = [[number(v) if isinstance(v, float) else v for v in r] for r in rows]
        parts += [f"## {heading}", md_table(cells, columns) if cells else "None."]
    return "\n\n".join(parts) + "\n"


def number(value: float | None, digits: int = 4, signed: bool = False) -> str:
    """A number for a table; ``n/a`` for none and NaN."""
    if value is None or value != value:
        return "n/a"
    return f"{value:{'+' if signed else ''}.{digits}f}"


def md_table(rows: list[list], header: list[str]) -> str:
    """A Markdown table; columns in which every cell is a number are aligned right."""
    cells = [["n/a" if c is None else str(c) for c in r] for r in rows]
    numeric = [bool(cells) and all(re.fullmatch(r"[+-]?[\d,]*\.?\d+%?|n/a", r[k]) for r in cells) for k in range(len(header))]
    lines = [header, ["---:" if n else "---" for n in numeric], *cells]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def verdict(passed: bool | None) -> str:
    return "INFO" if passed is None else "PASS" if passed else "FAIL"


def rewrite_block(path: str, name: str, body: str) -> bool:
    """Replace what stands between the file's markers of a name; False if the file or the markers are missing."""
    file, begin, end = Path(path), f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if not file.exists():
        return False
    text = file.read_text(encoding="utf-8")
    if begin not in text or end not in text:
        return False
    head, rest = text.split(begin, 1)
    file.write_text(f"{head}{begin}\n{body}\n{end}{rest.split(end, 1)[1]}", encoding="utf-8")
    return True


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report of small tables."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        rows = [[number(v) if isinstance(v, float) else v for v in r] for r in df.collect()]
        parts += [f"## {name}", md_table(rows, df.columns)]
    return "\n\n".join(parts) + "\n"
