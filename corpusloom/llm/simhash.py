"""SimHash near-dedup with pivot distance tables.

Fingerprints have 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles. Two fingerprints link at ``RADIUS`` or fewer
differing bits.

Pivot distances bound Hamming distances: for any reference p, |d(x,p) - d(y,p)| is at
most d(x,y). Two sets of references are used. The first set is zero and the 64
single-bit fingerprints; the offsets d(x,e_i) - d(x,0) of a close pair differ in at most
``RADIUS`` of them, so with the references dealt into RADIUS + 2 segments the pair has
equal offsets on at least two whole segments. An equi-join on the offsets of two
segments (they spell the bits there) therefore meets every close pair, and is what
makes the search a shuffle and not a comparison of all pairs. The second set is
``REFERENCES`` mixed fingerprints whose distances are computed once per fingerprint;
pairs that meet are discarded by their largest coordinate difference, and survivors
are verified by their exact distance.

Only distinct fingerprints are compared. Large buckets are dealt into tiles; a tile
gives a spanning forest of its links, not all of them, which loses no link between
components. Null texts count as empty; texts without words have fingerprint zero and
link like any other. Repeated rows link with each other. A null id never names a
component unless all its members' ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, over_tiles, spanning, tiled, wrapped
from corpusloom.session import stored

RADIUS = 4
SHINGLE = 4
SEED = 42
REFERENCES = 16
TILE = 1024
#: Shingles hashed at once, so that a very long text needs little memory.
BATCH = 1 << 18


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, in batches; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for k in range(0, len(starts), BATCH):
        parts = [joined[a:b] for a, b in zip(starts[k : k + BATCH].tolist(), ends[k : k + BATCH].tolist(), strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def references(number: int = REFERENCES) -> list[int]:
    """Fixed mixed fingerprints: digests of their numbers, signed."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", SEED)).view(np.int64)) for i in range(number)]


def _packed(fp: Column, refs: list[int]) -> Column:
    """Distances to eight references, a byte each."""
    total = F.lit(0).cast("long")
    for i, r in enumerate(refs):
        total = total.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r).cast("long"))).cast("long"), 8 * i))
    return total


def _keys(fp: Column, radius: int) -> Column:
    """One key for each pair of segments: its number and the fingerprint's bits there."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    bits = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cuts, cuts[1:])]
    wide = max(b - a for a, b in zip(cuts, cuts[1:]))
    pairs = list(combinations(range(radius + 2), 2))
    return F.array(*[F.lit(n << (2 * wide)).cast("long").bitwiseOR(F.shiftleft(bits[i], wide)).bitwiseOR(bits[j]) for n, (i, j) in enumerate(pairs)])


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the same components as all links of the distinct ``fp``."""
    refs = references()
    table = prints.select("fp", _packed(F.col("fp"), refs[:8]).alias("p0"), _packed(F.col("fp"), refs[8:]).alias("p1"))
    rows = tiled(table.withColumn("key", F.explode(_keys(F.col("fp"), radius))), "key", "fp", tile)

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        raw = part["fp"].to_numpy()
        fp, n = raw.view(np.uint64), len(raw)
        pivot = np.stack([part["p0"].to_numpy(), part["p1"].to_numpy()], axis=1).view(np.uint8).astype(np.int8)
        near = ~np.eye(n, dtype=bool)
        if part["lo"].iloc[0] != part["hi"].iloc[0]:
            side = part["chunk"].to_numpy()
            near &= side[:, None] != side[None, :]
        for k in range(pivot.shape[1]):
            near &= np.abs(pivot[:, None, k] - pivot[None, :, k]) <= radius
            if not near.any():
                return None
        i, j = np.nonzero(near)
        near[i, j] = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        edges = spanning(n, near.__getitem__)
        return pd.DataFrame({"a": raw[[u for u, _ in edges]], "b": raw[[v for _, v in edges]]}) if edges else None

    return over_tiles(rows, "key", work, "a long, b long")


def clusters(prints: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """A written table of (doc_id, fp) with component (a fingerprint) and component_id, the smallest doc_id reachable by links."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(linked(distinct))
    named = distinct.join(joined.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "component").join(least, "component").select("fp", "component", "component_id"), "fp")


def simhash_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per document: fingerprint as 16 hex digits and component_id."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "prints")
    return clusters(prints, lambda distinct: links(distinct, radius)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without near-copies: of each component the document with the smallest id.

    Ties of ids go by fingerprint, then by the hash of the text; rows that agree in all
    three are one document.
    """
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = wrapped(docs, doc_id=doc_id, text=text).withColumn("tag", tag)
    prints = fingerprints(keyed.select(F.struct("doc_id", "tag").alias("row"), "text"), "row", "text", shingle)
    prints = stored(prints.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.tag").alias("tag"), "fp"), "prints")
    return first_of_each(docs, keyed, clusters(prints, lambda distinct: links(distinct, radius)))


def first_of_each(docs: DataFrame, keyed: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of ``docs``, wrapped as ``keyed``, the document of each component with the smallest id."""
    grouped = grouped.where("doc_id <=> component_id")
    # of a component the rows with its smallest id; nearly always one
    best = grouped.groupBy("component", "doc_id").agg(F.min(F.struct("fp", "tag")).alias("_best")).select(F.col("doc_id").alias("_id"), F.col("_best.tag").alias("_tag"))
    kept = keyed.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_semi")
    return kept.dropDuplicates(["doc_id", "tag"]).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
