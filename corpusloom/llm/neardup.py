"""Near-copies by the exact Jaccard similarity of their word shingles, for the pipeline.

Two texts link if their sets of shingles, as 64-bit hashes, have a Jaccard similarity of
``NUMERATOR`` / ``DENOMINATOR`` (0.8) or more. The search misses no such pair: with all
sets written in one order, two sets that share so much share one of the first
n - ceil(0.8 n) + 1 shingles of either, so an equi-join on these prefixes meets every
link. Pairs that meet are discarded by their sizes and by the places of the shared
shingle, then by parity sketches: sets that differ in d shingles have sketches that differ in
at most d bits, so this too discards no link. Survivors are verified on the whole sets, and
only texts of survivors are read again.

Any order is right; a good one puts shingles that many texts have last. The ``COMMON``
most frequent ones of one text in ``SAMPLE`` are ranked for that: a list of fixed size,
which changes what is compared but not what is found.

SimHash goes first: the sets' fingerprints are linked through ``simhash.links``, its pivot
distance tables, and what they link is verified. A fingerprint cannot tell 0.8 from less, and
misses pairs, so the search above follows for what they leave apart.

Only distinct sets are compared. Crowded keys are dealt into tiles. Every set is first
verified with what SimHash links it to and with the smallest that it met, and of the other
pairs only those that this has not joined already. Texts without words have the empty set and link with each other. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.common import components, over_tiles, tiled, wrapped
from corpusloom.llm.simhash import clusters, first_of_each, shingle_hashes
from corpusloom.session import stored

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
TILE = 1024
#: Shingles ranked as common, found in one text of so many, with at least so many repeats in a batch.
COMMON = 1 << 16
SAMPLE = 8
REPEATS = 4


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as ascending hashes."""
    found = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles sets of these sizes share at least if they link."""
    both = NUMERATOR + DENOMINATOR
    return (NUMERATOR * (a + b) + both - 1) // both


def parity(s: np.ndarray) -> np.ndarray:
    """Packed bits, two to four times as many as there are shingles: the parity of the shingles that fall on each."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def set_fingerprint(s: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, unsigned."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(s), simhash.BATCH):
        total += np.unpackbits(s[k : k + simhash.BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(s), bitorder="little").view(np.uint64)[0])


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two sketches, the wider one folded to the width of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their ranks: the most frequent has the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            if not sets:
                continue
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            many = n >= REPEATS
            yield pa.record_batch([pa.array(found[many].view(np.int64)), pa.array(n[many])], names=["h", "n"])

    some = docs.where(F.pmod("tag", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long, n long")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toPandas()  # of fixed size
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(h), 0, -1)
    order = np.argsort(h)
    return h[order], rank[order]


def prefixes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, fp, sim, size, parity, prefix): the set's identity, SimHash fingerprint, size and sketch, and its first shingles in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for b in batches:
            prints, sims, sizes, sketches, heads = [], [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, shingle)
                n = len(s)
                prints.append(xxhash.xxh64_intdigest(s.tobytes()))
                sims.append(set_fingerprint(s))
                sizes.append(n)
                sketches.append(parity(s).tobytes())
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, rank[at], 0), kind="stable")]
                heads.append(s[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *heads])))
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, sims)], pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), listed], names=["doc_id", "tag", "fp", "sim", "size", "parity", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tag", "text").mapInArrow(run, f"doc_id {kind}, tag long, fp long, sim long, size int, parity binary, prefix array<long>")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, a < b, that join what fingerprints link: the sets of one with its least, the least of linked ones."""
    sets = prints.select("fp", "sim").distinct()
    least = stored(sets.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    same = sets.join(least, "sim").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    x, y = (least.select(F.col("sim").alias(s), F.col("least").alias(n)) for s, n in (("a", "x"), ("b", "y")))
    across = simhash.links(least.select(F.col("sim").alias("fp"))).join(x, "a").join(y, "b")
    return same.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).where("a <> b").distinct()


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, a < b, that share a shingle of their prefixes and can link by sizes and places."""
    rows = prints.select("fp", "size", F.posexplode("prefix").alias("place", "key")).repartition("key").dropDuplicates(["key", "fp"])
    rows = stored(rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"), "prefixes")

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        fp, size, place = part["fp"].to_numpy(), part["size"].to_numpy(np.int64), part["place"].to_numpy(np.int64)
        i, j = np.nonzero(fp[:, None] < fp[None, :])
        if part["lo"].iloc[0] != part["hi"].iloc[0]:
            side = part["chunk"].to_numpy()
            cross = side[i] != side[j]
            i, j = i[cross], j[cross]
        # no shared shingle comes before the first, and at the first this bounds what is shared
        good = np.minimum(size[i] - place[i], size[j] - place[j]) >= least_overlap(size[i], size[j])
        return pd.DataFrame({"a": fp[i[good]], "b": fp[j[good]]}) if good.any() else None

    return over_tiles(tiled(rows, "key", "fp", TILE), "key", work, "a long, b long").distinct()


def sieved(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose sketches are as near as those of linked sets must be."""
    sketch = prints.select("fp", "size", "parity").dropDuplicates(["fp"])
    x, y = (sketch.select(F.col("fp").alias(fp), F.col("size").alias(n), F.col("parity").alias(s)) for fp, n, s in (("a", "m", "x"), ("b", "n", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            most = m + n - 2 * least_overlap(m, n)
            apart = [bits_apart(np.frombuffer(s.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)) for s, t in zip(batch.column(4), batch.column(5), strict=True)]
            keep = pa.array(np.array(apart, np.int64) <= most)
            yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(fp, set) of the sets that pairs name."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = stored(prints.join(named, "fp", "left_semi").groupBy("fp").agg(F.min("tag").alias("tag")).select("tag").distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingle_set(text, shingle)
                one = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch([pa.array([xxhash.xxh64_intdigest(s.tobytes())], pa.uint64()).view(pa.int64()), one], names=["fp", "set"])

    texts = docs.select("tag", "text").join(wanted, "tag", "left_semi").dropDuplicates(["tag"]).select("text")
    return stored(texts.mapInArrow(run, "fp long, set array<long>").dropDuplicates(["fp"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), sets.select(F.col("fp").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                s, t = (v[o[r] : o[r + 1]] for o, v in ends)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                same = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep[r] = same >= least_overlap(len(s), len(t))
            yield pa.record_batch([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) that join the same components as all links of the distinct sets."""
    near = stored(sieved(simhash_pairs(prints), prints), "near")
    pairs = stored(sieved(candidates(prints), prints), "pairs")
    sets = _sets(docs, prints, pairs.unionByName(near), shingle)
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = stored(verified(near.unionByName(least).distinct(), sets), "first")
    joined = components(first)
    x, y = joined.select(F.col("id").alias("a"), F.col("component").alias("c")), joined.select(F.col("id").alias("b"), F.col("component").alias("d"))
    apart = pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")
    return first.unionByName(verified(apart, sets))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without near-copies: of each component the document with the smallest id, as simhash.one_of_each."""
    keyed = wrapped(docs, doc_id=doc_id, text=text).withColumn("tag", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    prints = stored(prefixes(keyed, shingle), "prints")
    grouped = clusters(prints.select("doc_id", "tag", "fp"), lambda distinct: links(keyed, prints, shingle))
    return first_of_each(docs, keyed, grouped)
