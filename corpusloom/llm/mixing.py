"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is one stream: its documents in hashed order, end to end, repeated when
the target asks for more than it has. Streams are cut into blocks of equal size in
words. Slot n of the mix has the golden-ratio point frac(n * phi); cumulative target
shares map it to a source, and the rank of the slot among its source's slots is the
block that it takes. A source gives as many blocks as points fall on it, so the schedule
sets the counts (near the targets, as such points are spread evenly) and, as slots are
written in order, the order: any stretch of the mix holds the sources by their shares.
No random number is drawn, so reruns agree.

Ranks and stream positions are prefix sums in two levels (hash buckets, slot
segments), so a source with most of the rows is spread over all tasks.

Null texts have size 0 and are never taken; a null source is a source, ordered last.
Repeated rows are documents of their own. An empty table, or one without words, gives
targets of 0 and takes nothing. Columns of any name may come along.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import small, word_count, words, wrapped
from corpusloom.session import stored

#: Words of a block at most, and the slots below which blocks are made smaller (to one word).
BLOCK = 256
SLOTS = 1 << 18
CAP = 3.0
CELLS = 1024
#: Slots ranked together, and documents of a source placed together (about).
SEGMENT = 1 << 16
BUCKET_ROWS = 1 << 16
#: Words of a partition of the written mix (about).
PART_WORDS = 1 << 23
PHI = (math.sqrt(5) - 1) / 2
#: frac(phi * 2^20) to full precision, so that points of high slots keep theirs.
PHI_HIGH = float(Decimal("0.6180339887498948482045868343656381177") * 2**20 % 1)


def targets(sizes: DataFrame, weights: DataFrame | None = None, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """Sources with weight and target from (source, source_size).

    Without ``weights`` (source, weight) sources by code point, null last, weigh 1, 2,
    3 and again. ``share`` of all words is dealt by weight; a target stops at ``cap``
    times its source and the excess goes to the others by weight until none is above:
    with sources ordered by cap over weight, the ones that stop are a prefix, found by
    running sums. One narrow row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    if weights is None:
        s = s.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        s = s.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0}).where("weight > 0")
    everything = Window.partitionBy()
    up = Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * F.lit(float(cap))
    s = s.withColumns({"_most": most, "_ratio": most / F.col("weight")})
    s = s.withColumns({"_below": F.coalesce(F.sum("_most").over(up), F.lit(0.0)), "_light": F.coalesce(F.sum("weight").over(up), F.lit(0.0)), "_total": F.sum("source_size").over(everything) * F.lit(float(share)), "_weights": F.sum("weight").over(everything)})
    s = s.withColumn("_level", (F.col("_total") - F.col("_below")) / (F.col("_weights") - F.col("_light")))
    s = s.withColumn("_level", F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "sid"))).over(everything))
    goal = F.when(F.col("_level").isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), F.col("_level") * F.col("weight")))
    return s.select("sid", "source", "source_size", "weight", goal.alias("target"), F.floor("_most").cast("long").alias("most"))


def scheduled(sizes: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """The sources with their quotas, the slots (slot, sid, block), words of a block, number of slots.

    A quota is what the source's slots hold: its blocks, less what lies beyond the cap.
    """
    sources = stored(targets(sizes, weights), "targets")
    total = int(sources.agg(F.sum("target")).first()[0] or 0)
    block = max(1, min(BLOCK, total // SLOTS))
    number = -(-total // block)
    slots = stored(schedule(sources, number, block), "slots")
    got = slots.groupBy("sid").agg(F.count("*").alias("got"))
    quota = F.least(F.coalesce("got", F.lit(0)) * F.lit(block), F.col("most"))
    return stored(sources.join(got, "sid", "left").withColumn("quota", quota).drop("got"), "quotas"), slots, block, number


def schedule(sources: DataFrame, number: int, block: int) -> DataFrame:
    """The slots (slot, sid, block) of the mix: points mapped to sources by target share, ranked per source."""
    upto = Window.orderBy("sid")  # a narrow row per source
    whole = F.sum("target").over(Window.partitionBy())
    shares = sources.where("target > 0").select("sid", "most", (F.sum("target").over(upto) / whole).alias("hi"), (F.col("target") / whole).alias("share"), F.row_number().over(Window.orderBy(F.desc("sid"))).alias("last"))
    shares = shares.select("sid", "most", (F.col("hi") - F.col("share")).alias("lo"), F.when(F.col("last") == 1, 2.0).otherwise(F.col("hi")).alias("hi"))
    below = F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))  # borders meet exactly
    shares = shares.withColumn("lo", below)
    first, last = F.least(F.floor(F.col("lo") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = stored(shares.withColumn("cell", F.explode(F.sequence(first, last))), "cells")
    n = F.col("id")
    point = F.shiftright(n, 20) * PHI_HIGH + n.bitwiseAND(F.lit((1 << 20) - 1)) * PHI
    slots = sources.sparkSession.range(number).select(n.alias("slot"), (point - F.floor(point)).alias("u"), F.floor(n / F.lit(SEGMENT)).alias("segment")).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(small(cells), "cell").where("u >= lo and u < hi").select("slot", "sid", "most", "segment")
    counts = slots.groupBy("sid", "segment").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("sid").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "segment", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("segment", "sid").orderBy("slot")) - 1
    ranked = slots.join(bases, ["segment", "sid"]).select("slot", "sid", "most", rank.alias("block"))
    return ranked.where(F.col("block") * block < F.col("most")).select("slot", "sid", "block")


def placed(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Narrow rows (doc_id, source, _size, k1, k2) with sid, source_size, target, quota and ``_start``, the place in the source's stream."""
    s = sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "quota")
    rows = narrow.join(small(s), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = max(64, -(-narrow.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.floor(F.shiftrightunsigned("k1", 11) / F.lit(float(2**53)) * buckets))
    sums = rows.groupBy("sid", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "_bucket").orderBy("k1", "k2", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["sid", "_bucket"]).withColumn("_start", F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return rows.drop("_base", "_bucket")


def passages(place: DataFrame, block: int, cut: bool) -> DataFrame:
    """What the quotas take of placed documents, per document and repetition; with ``cut``, per block of it.

    Adds epoch, at (the place in the repeated stream), block (of the first word) and words.
    """
    epochs = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("source_size")).cast("long") - 1)
    rows = place.where("_size > 0 and quota > 0").withColumn("epoch", F.explode(epochs))
    rows = rows.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("_start")).where("at < quota")
    rows = rows.withColumn("_end", F.least(F.col("at") + F.col("_size"), F.col("quota")))
    first = F.floor(F.col("at") / block)
    if not cut:
        return rows.withColumns({"block": first, "words": F.col("_end") - F.col("at")}).drop("_end")
    rows = rows.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / block))))
    words_ = F.least("_end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    return rows.withColumn("words", words_).drop("_end")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` of wrapped (doc_id, text, source) with _size and k1, k2: two hashes of the whole row.

    Rows of equal hashes are equal (but for maps, which do not hash), so that either may stand for the other.
    """
    own = [F.col("doc_id"), F.col("source"), F.col("text"), F.col("_doc")] if "map<" not in rows.schema["_doc"].dataType.simpleString() else [F.col("doc_id"), F.col("source"), F.col("text")]
    tag = lambda salt: F.xxhash64(F.lit(salt), *own, *[c.isNull() for c in own[:3]])
    return rows.withColumns({"_size": word_count(F.col("text")), "k1": tag("mix"), "k2": tag("key")})


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int, int]:
    """The placed documents, narrow, the slots, words of a block, number of slots."""
    rows = keyed(wrapped(docs.select(doc_id, source, text), doc_id=doc_id, text=text, source=source))
    narrow = stored(rows.select("doc_id", "source", "_size", "k1", "k2"), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"))
    sources, slots, block, number = scheduled(sizes, weights)
    return stored(placed(narrow, sources), "placed"), slots, block, number


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: size, its source's size and target, the words the mix takes of it, and the first slot that does."""
    place, slots, block, _ = mix(docs, None, doc_id, text, source)
    keys = ["doc_id", "source", "_size", "source_size", "target", "sid", "_start"]
    mixed = passages(place, block, cut=True).join(slots, ["sid", "block"])
    used = mixed.groupBy(*keys).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    unused = place.where("_size = 0 or _start >= quota").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return used.unionByName(unused).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "source", "first_slot")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each time a document is taken, in the order of slots.

    Partitions are stretches of slots, sorted, so written files follow the schedule. A
    document stands at the slot of its first word. The one at which a source's quota ends
    keeps the words taken, joined by spaces.
    """
    whole = keyed(wrapped(docs, doc_id=doc_id, text=text, source=source))
    narrow = stored(whole.select("doc_id", "source", "_size", "k1", "k2"), "sizes")
    sources, slots, block, number = scheduled(narrow.groupBy("source").agg(F.sum("_size").alias("source_size")), weights)
    picks = passages(placed(narrow, sources), block, cut=False).join(slots, ["sid", "block"])
    picks = stored(picks.select("k1", "k2", F.col("_size").alias("_all"), "slot", "at", "words"), "picks")
    one = whole.where("_size > 0").withColumn("_nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("_nth = 1")
    rows = one.select("_doc", "text", "k1", "k2").join(picks, ["k1", "k2"])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number * block // PART_WORDS))
    rows = rows.repartitionById(parts, F.floor(F.col("slot") * parts / max(number, 1)).cast("int")).sortWithinPartitions("slot", "at")
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("words").cast("int")), " ")
    taken = F.when(F.col("words") == F.col("_all"), F.col("text")).otherwise(cut)
    return rows.select(*[(taken if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
