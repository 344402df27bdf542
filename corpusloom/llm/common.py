"""Shared parts of the operators: reading, materialising columns, tiles, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import stored

#: White space of the contracts: space and 09 to 0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: A side of a join with more rows than this is not broadcast.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is counted to have at most ``SMALL`` rows.

    Else it takes part in joins as any other. For tables with a row per source: without
    the mark the wide side would be shuffled by source before Spark knows their size.
    """
    return F.broadcast(df) if df.count() <= SMALL else df


def wrapped(df: DataFrame, **columns: str) -> DataFrame:
    """The rows as one struct ``_doc``, beside the named columns: names of other columns cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"), *[F.col(c).alias(n) for n, c in columns.items()])


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, which Catalyst does not fold back into their users.

    Without it a lambda that refers to a computed array would compute it per element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def running_totals(lengths: Column, width: int = 256) -> Column:
    """Sums of ``lengths`` before each element, in blocks so that long arrays stay cheap."""
    n = F.size(lengths)
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def scan(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(start.alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(lengths, b * width + 1, width))).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, scan(sums, zero), scan))


# --- tiles -------------------------------------------------------------------


#: Comparisons of a task that works on tiles.
TASK_PAIRS = 1 << 26


def tiled(rows: DataFrame, key: str, ident: str, side: int) -> tuple[DataFrame, int]:
    """Deal the rows of every key of two rows or more into tiles; with the number of tasks that their work asks for.

    A key of at most ``side`` rows is one tile. A larger one is dealt by hash into
    chunks of about ``side`` rows, with one tile for each pair of chunks, so that any
    two rows of a key meet in a tile, no task holds a whole large key, and the rows
    that meet are never written out as pairs. Adds chunk, lo and hi (the tile). Tasks
    follow the pairs of rows that meet, as bytes say little of quadratic work.
    """
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0.0
    chunks = F.ceil(F.col("_n") / F.lit(side)).cast("int")
    dealt = rows.join(small(sizes), key).withColumn("chunk", F.when(F.col("_n") <= side, 0).otherwise(F.pmod(F.xxhash64(F.lit("tile"), ident), chunks).cast("int")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    return dealt.withColumns({"lo": F.least("chunk", "_other"), "hi": F.greatest("chunk", "_other")}).drop("_n", "_other"), tasks


def over_tiles(dealt: tuple[DataFrame, int], key: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Run ``work`` once per tile of ``tiled``, streaming through partitions sorted by tile.

    Cheaper than a grouped map for many small tiles; memory is one batch and one tile.
    """
    names = [key, "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []

        def done(part: pd.DataFrame) -> None:
            if len(part) > 1 and (got := work(part)) is not None and len(got):
                out.append(got)

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[n].to_numpy() for n in names]
            new = np.zeros(len(batch), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            if held and any(held[-1][n].iloc[-1] != batch[n].iloc[0] for n in names):
                new[0] = True
            cuts = np.flatnonzero(new)
            if not len(cuts):
                held.append(batch)
                continue
            if held or cuts[0]:
                held.append(batch.iloc[: cuts[0]])
                done(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                done(batch.iloc[a:b])
            held = [batch.iloc[cuts[-1] :]]
            if sum(map(len, out)) > 20_000:
                yield pd.concat(out, ignore_index=True)
                out.clear()
        if held:
            done(pd.concat(held, ignore_index=True))
        if out:
            yield pd.concat(out, ignore_index=True)

    rows, tasks = dealt
    return rows.repartition(tasks, *names).sortWithinPartitions(*names).mapInPandas(run, schema)


def spanning(n: int, linked: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1, by breadth-first search over ``linked`` rows of booleans."""
    left, edges = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(linked(u) & left)
            left[found] = False
            edges += [(u, int(v)) for v in found]
            queue += found.tolist()
    return edges


# --- components --------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as (id, component): the smallest id reachable.

    Contraction by random priorities: every node takes the best priority among itself
    and its neighbours, edges move to the nodes taken, and nodes halve in every round
    whatever the graph. Priorities are hashes, so a rerun agrees. Only minima are
    aggregated, which Spark combines before the shuffle, so a node with very many
    edges is no hot spot. Each round is written to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stored(edges.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("r"), F.col(c).alias("id"))
        ends = edges.select(F.col("a").alias("id"), F.explode(F.array(rank("a"), rank("b"))).alias("p")).unionAll(edges.select(F.col("b").alias("id"), F.explode(F.array(rank("a"), rank("b"))).alias("p")))
        taken = stored(ends.groupBy("id").agg(F.min("p").alias("p")).select("id", F.col("p.id").alias("to")), "taken")
        maps.append(taken)
        x, y = taken.select(F.col("id").alias("a"), F.col("to").alias("c")), taken.select(F.col("id").alias("b"), F.col("to").alias("d"))
        moved = edges.join(x, "a").join(y, "b").where("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        edges = stored(moved, "edges")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    last = maps[-1]
    for taken in reversed(maps[:-1]):
        last = taken.join(last.select(F.col("id").alias("to"), F.col("to").alias("root")), "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    last = stored(last, "roots")
    least = last.groupBy("to").agg(F.min("id").alias("component"))
    return last.join(least, "to").select("id", "component")
