"""Session construction and the shared working folder of a Spark application.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor can reach; only a session that names none (tests, a laptop) gets
one of its own.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_owned: set[tuple[str, str]] = set()
_made: dict[str, list[str]] = {}
_writing: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()
#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", app: str = "corpusloom") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    root = f"{base.rstrip('/')}/corpusloom-{app}"
    if (app, root) not in _owned:
        _owned.add((app, root))
        atexit.register(_drop_quietly, spark, root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> int:
    """How many paths of the shared folder were named so far, for ``forget_since``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def forget_since(spark: SparkSession, number: int, *kept: DataFrame) -> None:
    """Delete what was written to paths named after the first ``number``, but for the tables ``kept``."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for t in kept for f in t.inputFiles()}
    paths = _made.get(spark.sparkContext.applicationId, [])
    for path in paths[number:]:
        if path.rsplit("/", 1)[1] not in own:
            drop_path(spark, path)
    paths[number:] = [p for p in paths[number:] if p.rsplit("/", 1)[1] in own]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it for, for readers and writers that are not Spark's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


@contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """While a write runs, shuffle files go with the query that made them; the session's own setting comes back after the last of several writes."""
    app = spark.sparkContext.applicationId
    with _lock:
        n, own = _writing.get(app) or (0, spark.conf.get(CLEANUP, "false"))
        _writing[app] = n + 1, own
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, own = _writing.pop(app)
            if n > 1:
                _writing[app] = n - 1, own
            else:
                spark.conf.set(CLEANUP, own)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and nothing
    needs the shuffle files of the write any more: they are removed at its end.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, folder)


def _drop_quietly(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the JVM may be gone at exit; the folder then stays for the operator to clear
        pass
