"""Sources: each gives a typed DataFrame; file order is kept as (path, number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import atoms, normalize, once, usable
from corpusloom.functions.wellformed import asked_of, has_marker, well_formed
from corpusloom.operators.pools import keep_first
from corpusloom.session import stored

SPLIT_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("command", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("split", T.StringType())])
SESSION_SCHEMA = T.StructType([T.StructField("full_session", T.StringType()), T.StructField("Set_Fingerprint", T.ArrayType(T.StringType()))])
#: All line ends that a text may use, beyond the reader's own CR and LF.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The source registry (source, label, dataset, kind): static and small."""
    return spark.createDataFrame(rows, "source string, label int, dataset int, kind string")


def lines_of(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line of a text column, with its number from 0."""
    return df.select(*(keep or []), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, raw) of text files, one command per line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", LINE_END)).alias("pos", "raw"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, raw) of files that hold one JSON array of strings."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<string>").alias("a"))
    return whole.select("path", F.posexplode("a").alias("pos", "raw"))


def first_of_equals(raw: DataFrame, by: list[str] | None = None, order: list[str] | None = None, narrow: bool = False) -> DataFrame:
    """Normalise, drop the unusable, and keep the first of equals; with ``narrow`` of raw only what the rules ask, so that a line is not shuffled twice over."""
    by, order = by or [], order or ["path", "pos"]
    named = once(raw, command=normalize(F.col("raw"))).where(usable(F.col("command")))
    if narrow:
        named = named.withColumn("raw", asked_of(F.col("raw")))
    return keep_first(named, [*by, "command"], order)


def pooled(raw: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The same with the names of violated rules.

    Dedup comes before the rules so that they run once per command.
    """
    return well_formed(first_of_equals(raw, by, order))


def required(spark: SparkSession, *paths: str) -> list[str]:
    """``paths``; an error names the first that is not there. Globs and any file system that Spark reads are fine."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if not path.getFileSystem(conf).globStatus(path):
            raise FileNotFoundError(f"missing extract: {name}")
    return list(paths)


def session_atoms(df: DataFrame, order: list[str], text: str = "full_session", fingerprint: str = "Set_Fingerprint") -> DataFrame:
    """(command, raw, violations, harmless_only) of the usable commands of sessions.

    raw is the first in ``order``. A command is harmless_only if every session that has it is
    annotated as exactly ("Harmless",); a missing annotation is an empty one.
    """
    harmless = F.coalesce(F.col(fingerprint), F.array().cast("array<string>")) == F.array(F.lit("Harmless"))
    rows = df.where(F.col(text).isNotNull()).select(F.struct(*order).alias("at"), harmless.alias("harmless"), F.posexplode(atoms(F.col(text))).alias("pos", "raw"))
    rows = once(rows, command=normalize(F.col("raw"))).where(usable(F.col("command")))
    return well_formed(rows.groupBy("command").agg(F.min_by("raw", F.struct("at", "pos")).alias("raw"), F.bool_and("harmless").alias("harmless_only")))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """The commands of a session table; two of its columns are read."""
    return session_atoms(spark.read.schema(SESSION_SCHEMA).parquet(path), ["full_session"])


def session_pool(df: DataFrame, order: list[str], text: str = "full_session", fingerprint: str = "Set_Fingerprint") -> tuple[DataFrame, DataFrame]:
    """The pool of sessions, without ill-formed and harmless-only commands, and a report of what was dropped in one row.

    The report also counts the pool's commands with a marker of an attack; that never decides on a row.
    """
    found = stored(session_atoms(df, order, text, fingerprint), "atoms")
    fine, harmless = F.size("violations") == 0, F.col("harmless_only")
    kept = fine & ~harmless
    counts = {"distinct_atoms": F.count("*"), "well_formed_dropped": F.count_if(~fine), "after_well_formed": F.count_if(fine), "harmless_only_dropped": F.count_if(fine & harmless), "after_harmless_drop": F.count_if(kept), "marker_probe_pool_coverage": F.count_if(kept & has_marker(F.col("command")))}
    report = df.agg(F.count("*").alias("sessions")).crossJoin(found.agg(*[c.alias(n) for n, c in counts.items()]))  # one row each
    return found.where(kept).select("command", "raw"), report


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(tactic, n) of an expert annotation file: run lengths like ``Tactic - 2 -- Other - 5`` summed."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string, struct<session: string, labels: string>>")).alias("k", "v"))
    return run_lengths(parsed.select(F.col("v.labels").alias("labels")))


def run_lengths(df: DataFrame, labels: str = "labels") -> DataFrame:
    """(tactic, n): run lengths summed by tactic."""
    part = df.select(F.explode(F.split(F.coalesce(labels, F.lit("")), "--")).alias("part"))
    pattern = r"^\s*(.*?)\s*-\s*(\d+)\s*$"
    part = part.where(F.col("part").rlike(pattern)).select(F.regexp_extract("part", pattern, 1).alias("tactic"), F.regexp_extract("part", pattern, 2).cast("long").alias("k"))
    return part.groupBy("tactic").agg(F.sum("k").alias("n"))


def harmless_rate(tactics: DataFrame) -> DataFrame:
    """(harmless, statements, harmless_share) of summed tactics (tactic, n): one row."""
    out = tactics.agg(F.coalesce(F.sum(F.when(F.col("tactic") == "Harmless", F.col("n"))), F.lit(0)).alias("harmless"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements"))
    return out.withColumn("harmless_share", F.round(F.col("harmless") / F.nullif("statements", F.lit(0)), 4))


def split_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Split files with literal ``nan`` and ``null`` kept as text, ordered by id; fails on blank or repeated commands."""
    reader = spark.read.schema(SPLIT_SCHEMA).option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").option("multiLine", True)
    df = reader.csv(list(paths))
    bad = df.groupBy("command").agg(F.count("*").alias("n")).where("n > 1 or command is null or trim(command) = ''").limit(1).count()
    if bad:
        raise ValueError("blank or repeated commands")
    return df.orderBy("id")


def chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(command, drop_reason) of chat files: the last message, which must be the assistant's and one line."""
    schema = "messages array<struct<role: string, content: string>>, category string, utility string, _corrupt_record string"
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    last = F.try_element_at("messages", F.lit(-1))
    content = F.trim(F.regexp_replace(F.regexp_replace(last["content"], r"^\s*```[\w-]*\s*\n?", ""), r"\n?\s*```\s*$", ""))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "bad_json").when(last.isNull() | (last["role"] != "assistant"), "no_assistant").when(content == "", "empty").when(content.contains("\n"), "multi_line")
    return df.select(content.alias("command"), "category", "utility", reason.alias("drop_reason"))


def union_splits(frames: dict[str, DataFrame], names: tuple[str, ...] = ("completion", "command", "cmd", "output")) -> DataFrame:
    """Splits of one corpus under each one's own command column, with the split's name."""
    out = None
    for split, df in frames.items():
        column = next(c for c in names if c in df.columns)
        one = df.select(F.col(column).cast("string").alias("command"), *([F.col("category")] if "category" in df.columns else []), F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def completions(df: DataFrame, column: str = "completion") -> DataFrame:
    """Prompt and continuation salvage: one row gives every line that is a command after its prompt, or the whole if none has one."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.split(F.trim(column), "\n").alias("lines"))
    prompted = F.filter("lines", lambda x: x.rlike(r"^(?:\$|>) "))
    chosen = F.when(F.size(prompted) > 0, F.transform(prompted, lambda x: F.regexp_replace(x, r"^(?:\$|>)\s+", ""))).when(F.size("lines") == 1, F.col("lines")).otherwise(F.array().cast("array<string>"))
    return rows.select("row", F.posexplode(chosen).alias("pos", "command"))


def paged_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, command) of paged JSON arrays; unreadable files give nothing, the first of equal ids stays."""
    df = spark.read.schema("id string, command string").option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("path", F.col("_metadata.file_path"))
    return keep_first(df.where("id is not null"), ["id"], ["path", "command"]).select("id", "command")


def markdown_examples(spark: SparkSession, path: str, platforms: tuple[str, ...] = ("common", "linux")) -> DataFrame:
    """(path, pos, raw) of back-quoted example lines in a tree of Markdown pages of the given platforms."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    df = df.where(F.regexp_extract("path", r"/([^/]+)/[^/]+\.md$", 1).isin(*platforms))
    rows = df.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"^`[^`]+`\s*$")).select("path", "pos", F.regexp_extract("line", r"^`([^`]+)`", 1).alias("raw"))


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of a tree of files, for the parsers."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
