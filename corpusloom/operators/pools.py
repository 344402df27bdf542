"""Operators on pools of commands: dedup, deals, caps, conflicts, balance, splits.

Order is never drawn: it is the MD5 of seed, call site and key, so results do not depend
on partitioning and SQL can repeat them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions.ranks import hex_place, running
from corpusloom.session import stored


def scoped_hash(site: str, *keys: str | Column, seed: int = DEFAULT.seed) -> Column:
    """The order key of a call site."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(site), *keys))


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def deal(df: DataFrame, by: list[str], key: str, item: str, site: str, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """Round-robin over the values of ``key`` within ``by``: adds round (from 1) and, with ``most``, cuts each ``by``.

    All keys give one row before any gives its second. Within a round, keys follow the
    order of their hashes, so a cut takes as many different keys as it can.
    """
    w = Window.partitionBy(*by, key).orderBy(scoped_hash(site, item), item)
    out = df.withColumn("round", F.row_number().over(w))
    if rounds is not None:
        out = out.where(F.col("round") <= rounds)
    if most is not None:
        quota = out.select(*by).distinct().withColumn("_quota", F.lit(most))
        out = cut_rounds(out, quota, by, key, site, most)
    return out


def cap_per_shape(df: DataFrame, by: list[str], shape: str, item: str, k: int = DEFAULT.max_per_shape, most: int | None = None) -> DataFrame:
    return deal(df, by, shape, item, "cap", k, most).drop("round")


def pool_shapes(df: DataFrame, by: list[str], shape: str) -> DataFrame:
    """Rows, distinct shapes, rows per shape and the largest shape of each group; counted per shape first."""
    t = df.groupBy(*by, shape).agg(F.count("*").alias("n"))
    return t.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_shapes"), (F.sum("n") / F.count("*")).alias("rows_per_shape"), F.max("n").alias("max_in_shape"))


def exact_conflicts(df: DataFrame, item: str = "command", label: str = "label") -> DataFrame:
    """Items that occur under both labels, anywhere."""
    return df.groupBy(item).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(item)


def shape_conflicts(df: DataFrame, item: str = "command", shape: str = "shape", label: str = "label", dataset: str = "dataset", threshold: float = DEFAULT.shape_conflict_threshold) -> tuple[DataFrame, DataFrame]:
    """The report per dataset, and the items to drop where it fired.

    A shape of both labels conflicts; exact hits are taken out of the shapes first but
    count in the share. The rule is all or nothing per dataset.
    """
    exact = exact_conflicts(df, item, label).withColumn("_exact", F.lit(True))
    rows = df.join(exact, item, "left").withColumn("_exact", F.coalesce("_exact", F.lit(False)))
    rest = rows.where(~F.col("_exact"))
    both = rest.groupBy(dataset, shape).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(dataset, shape, F.lit(True).alias("_both"))
    rows = rows.join(both, [dataset, shape], "left").withColumn("_hit", ~F.col("_exact") & F.coalesce("_both", F.lit(False)))
    attack = F.col(label) == 1
    report = rows.groupBy(dataset).agg(
        F.count_if(attack).alias("pool"),
        F.count_if(attack & F.col("_exact")).alias("exact"),
        F.count_if(attack & F.col("_hit")).alias("rows_hit"),
        F.count_distinct(F.when(F.col("_hit"), F.col(shape))).alias("shapes_hit"),
    )
    share = F.coalesce((F.col("exact") + F.col("rows_hit")) / F.nullif(F.col("pool"), F.lit(0)), F.lit(0.0))
    report = report.withColumn("share", share).withColumn("fired", F.col("share") > threshold)
    drop = rows.where("_hit").join(report.where("fired").select(dataset), dataset, "left_semi").select(item)
    return report, exact.select(item).unionByName(drop).distinct()


def apportioned(df: DataFrame, by: list[str], name: str, need: str, weight: str, limit: str) -> DataFrame:
    """``df`` with ``take``: per ``by``, ``need`` units dealt by weight, none above its limit.

    There is one level at which min(limit, level x weight) sums to what is dealt: with rows
    ordered by limit over weight, those at their limit come first, so running sums find it.
    Whole parts are dealt, then one more each to the largest remainders, ties by name.
    """
    every = Window.partitionBy(*by)
    up = every.orderBy("_ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    w, most = F.col(weight).cast("double"), F.col(limit).cast("double")
    rows = df.withColumns({"_ratio": F.when(w > 0, most / F.nullif(w, F.lit(0.0))).otherwise(float("-inf")), "_need": F.least(F.col(need).cast("double"), F.sum(most).over(every))})
    rows = rows.withColumns({"_before": F.coalesce(F.sum(most).over(up), F.lit(0.0)), "_heavy": F.sum(w).over(every) - F.coalesce(F.sum(w).over(up), F.lit(0.0))})
    # in units of all open weight, so that exact shares stay exact
    fits = (w > 0) & ((F.col("_need") - F.col("_before")) * w / F.nullif("_heavy", F.lit(0.0)) <= most)
    first = F.min(F.when(fits, F.struct("_ratio", F.col(name).alias("n"), (F.col("_need") - F.col("_before")).alias("rest"), F.col("_heavy").alias("heavy")))).over(every)
    rows = rows.withColumn("_first", first)
    is_open = (w > 0) & F.col("_first").isNotNull() & (F.struct("_ratio", F.col(name).alias("n")) >= F.struct(F.col("_first._ratio"), F.col("_first.n")))
    share = F.when(F.col("_need") <= 0, 0.0).when(is_open, F.col("_first.rest") * w / F.col("_first.heavy")).otherwise(F.when(w > 0, most).otherwise(0.0))
    rows = rows.withColumns({"_whole": F.floor(share), "_part": share - F.floor(share)})
    spare = F.col("_need") - F.sum("_whole").over(every)
    turn = F.row_number().over(every.orderBy(F.desc("_part"), name))
    take = (F.col("_whole") + F.when((turn <= spare) & (F.col("_whole") < most), 1).otherwise(0)).cast("long")
    return rows.withColumn("take", take).drop("_ratio", "_need", "_before", "_heavy", "_first", "_whole", "_part")


def allocated(df: DataFrame, by: list[str], name: str, want: str, available: str, share: float = DEFAULT.max_source_share) -> DataFrame:
    """``df`` (a row per source) with ``take`` and ``breached``: picks by availability, none above ``share`` of what
    is wanted while the others can serve; what they cannot is dealt over what is left of all."""
    every = Window.partitionBy(*by)
    rows = df.withColumn("_want", F.greatest(F.lit(0), F.least(F.col(want), F.sum(available).over(every))))
    ceiling = F.greatest(F.lit(1), F.floor(F.col("_want") * F.lit(float(share))))
    rows = rows.withColumn("_most", F.least(F.col(available), ceiling))
    rows = apportioned(rows, by, name, "_want", available, "_most").withColumnRenamed("take", "_one")
    rows = rows.withColumn("_short", F.col("_want") - F.sum("_one").over(every)).withColumn("_room", F.col(available) - F.col("_one"))
    rows = apportioned(rows, by, name, "_short", "_room", "_room")
    return rows.withColumns({"take": F.col("take") + F.col("_one"), "breached": F.col("_short") > 0}).drop("_want", "_most", "_one", "_short", "_room")


def balanced(df: DataFrame, shape: str = "shape", item: str = "command", share: float = DEFAULT.max_source_share, ratio: int = DEFAULT.normal_per_attack) -> DataFrame:
    """Per dataset all attacks, and normal rows up to ``ratio`` times as many, apportioned over sources and dealt over shapes.

    Quotas are a row per (dataset, source). Rows are counted per round of a source first, so
    that only the round in which its quota ends has to be ranked. What is chosen must be what
    is wanted, and no row twice; else the plan fails as it runs.
    """
    counts = df.groupBy("dataset", "source").agg(F.count_if(F.col("label") == 1).alias("_attacks"), F.count_if(F.col("label") == 0).alias("_normal"))
    want = F.least(F.sum("_normal").over(Window.partitionBy("dataset")), ratio * F.sum("_attacks").over(Window.partitionBy("dataset")))
    quota = allocated(counts.withColumn("_wanted", want), ["dataset"], "source", "_wanted", "_normal", share).select("dataset", "source", F.col("take").alias("_quota"))
    dealt = deal(df.where("label = 0"), ["dataset", "source"], shape, item, "balance")
    normal = stored(cut_rounds(dealt, quota, ["dataset", "source"], shape, "balance").select(*df.columns), "normal")
    got = normal.groupBy(F.col("dataset").alias("_d"), F.col("source").alias("_s")).agg(F.count("*").alias("_got"))
    wanted = quota.join(got, F.col("dataset").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    twice = normal.groupBy("dataset", item).agg(F.count("*").alias("_k"))
    return guarded(df.where("label = 1").unionByName(normal), (wanted, F.col("_got") != F.col("_quota"), _named("not as many rows as wanted:", "dataset", "source", "_got", "_quota")), (twice, F.col("_k") > 1, _named("chosen twice:", item)))


def cut_rounds(dealt: DataFrame, quota: DataFrame, by: list[str], key: str, site: str, most: int | None = None) -> DataFrame:
    """The first ``_quota`` rows of each ``by`` of a deal: whole rounds as far as they go, then the first by hash of the next.

    A round holds one row of a key, so ranking the last one is all that one task has to do; with
    ``most``, which no quota exceeds, every task sends that many rows of a round at most.
    """
    rounds = dealt.groupBy(*by, "round").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = rounds.withColumn("_before", before).join(quota, by).where("_before < _quota").select(*by, "round", (F.col("_quota") - F.col("_before")).alias("_left"), "_size")
    rows = dealt.join(rounds, [*by, "round"])
    turn = Window.partitionBy(*by).orderBy(scoped_hash(site, key), key)
    last = rows.where("_size > _left").withColumn("_turn", F.row_number().over(turn))
    if most is not None:
        last = last.where(F.col("_turn") <= most)
    last = last.where("_turn <= _left").drop("_turn")
    return rows.where("_size <= _left").unionByName(last).drop("_left", "_size")


def fitting(sizes: np.ndarray, goal: int) -> np.ndarray:
    """Which of the groups, taken in order, go into ``goal`` if one that would overshoot is passed over.

    Whole stretches at a time: all before the first that overshoots go in, and what is
    larger than the room left never will, so each round ends a stretch of any length.
    """
    chosen, open_ = np.zeros(len(sizes), bool), np.flatnonzero(sizes <= goal)
    while len(open_):
        sums = np.cumsum(sizes[open_])
        n = int(np.searchsorted(sums, goal, "right"))
        chosen[open_[:n]] = True
        goal -= int(sums[n - 1]) if n else 0
        open_ = open_[n:][sizes[open_[n:]] <= goal]
    return chosen


#: Groups of a (dataset, label) that one task may deal.
FEW_GROUPS = 100_000


def group_split(df: DataFrame, shape: str = "shape", train: float = DEFAULT.train_fraction, few: int = FEW_GROUPS) -> DataFrame:
    """Adds split: whole shape groups per (dataset, label) go to test, in hashed order, passing over those that would overshoot.

    As ``fitting`` does it, over running sums by ranges of the hash: of the groups that still fit, all
    before the first that overshoots go to test, and those larger than the room left are out.
    Each such stretch is a round; once no (dataset, label) has more than ``few`` groups
    left, what passes through one task is a number for each of them.
    """
    import pandas as pd

    by = ["dataset", "label"]
    groups = stored(df.groupBy(*by, shape).agg(F.count("*").alias("n")).withColumn("_order", scoped_hash("split", shape)), "groups")
    # half to even, as round() does
    room = groups.groupBy(*by).agg(F.bround(F.sum("n") * F.lit(1 - train), 0).cast("long").alias("_room"))
    taken = groups.limit(0).select(*by, shape)
    left = stored(groups.join(room, by).where(F.col("n") <= F.col("_room")), "open")
    while (left.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0) > few:
        sums = stored(running(left, by, hex_place("_order"), [F.col("_order"), F.col(shape)], _before=F.col("n")), "sums")
        fits = F.col("_before") + F.col("n") <= F.col("_room")
        taken = taken.unionByName(sums.where(fits).select(*by, shape))
        used = sums.groupBy(*by).agg(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("_used"))
        rest = sums.where(~fits).join(used, by).withColumn("_room", F.col("_room") - F.col("_used")).where(F.col("n") <= F.col("_room"))
        left = stored(rest.select(*by, shape, "n", "_order", "_room"), "open")

    def sides(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", shape])
        return part[fitting(part["n"].to_numpy(), int(part["_room"].iloc[0]))][[*by, shape]]

    kind = f"dataset {df.schema['dataset'].dataType.simpleString()}, label {df.schema['label'].dataType.simpleString()}, {shape} string"
    taken = taken.unionByName(left.groupBy(*by).applyInPandas(sides, kind)).withColumn("_test", F.lit(True))
    return df.join(taken, [*by, shape], "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def with_ids(df: DataFrame, item: str = "command") -> DataFrame:
    """A seeded order and ids d<dataset>_<number>; ranked in hash buckets, so no task sees a whole dataset."""
    df = df.withColumn("_h", scoped_hash("ids", item)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = df.groupBy("dataset", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("dataset").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("dataset", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("dataset", "_b").orderBy("_h", item)) - 1
    out = df.join(sizes, ["dataset", "_b"]).withColumn("id", F.format_string("d%d_%06d", "dataset", F.col("_base") + own))
    return out.drop("_h", "_b", "_base")


def guarded(df: DataFrame, *broken: tuple[DataFrame, Column, Column]) -> DataFrame:
    """``df``, failing while it is computed or written if one of ``broken`` has a row.

    Each is a frame, when a row of it breaks an invariant, and what to say then. They are
    branches of the plan that give no rows, so no job runs ahead of the one that needs ``df``.
    """
    out = df
    for frame, bad, message in broken:
        stop = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(False)
        out = out.unionByName(frame.where(stop).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
    return out


def _named(text: str, *columns: str) -> Column:
    return F.concat_ws(" ", F.lit(text), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def checked(df: DataFrame) -> DataFrame:
    """``df``, failing at run time where a build invariant is broken: a command in two datasets, or a shape of two labels in one."""
    both = df.groupBy("command").agg(F.min("dataset").alias("lo"), F.max("dataset").alias("hi"))
    mixed = df.groupBy("dataset", "shape").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    differ = F.col("lo") != F.col("hi")
    return guarded(df, (both, differ, _named("a command is in both datasets:", "command")), (mixed, differ, _named("a shape has two labels:", "shape")))
