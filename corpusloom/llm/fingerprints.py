"""SimHash fingerprints of documents, and permuted block tables to search them.

A text's terms are its shingles of ``SHINGLE`` words, or all of its words where it has
fewer. A term weighs as many units as its count has binary digits, so a term that is
repeated all over does not outvote the rest. The 128 bits of a term's MD5 vote with that
weight, for or against each bit of the fingerprint; a bit is 1 if the votes for it are more
than those against it. Texts without words have fingerprint zero. Equal texts have equal
fingerprints. The share of bits in which two fingerprints differ estimates the angle
between their term vectors, and the likeness is its cosine, not below 0.

Search within a Hamming radius: fingerprints are cut into radius + intact blocks, of which
a pair within the radius agrees on ``intact`` at least. For each choice of that many blocks
there is a table, permuted so that these blocks come first, and pairs that agree on them
meet in it. More intact blocks mean more tables with longer keys: their number follows the
number of fingerprints, which changes the work and not the result. Only distinct
fingerprints are in the tables, each with the number of its documents. A crowded key is
dealt into tiles; a tile counts the pairs whose first equal blocks are its own, so that a
pair counts once, and gives a count for each fingerprint and no pairs.

The edited text of a document ends with the beginning of the next document. Documents are
ordered by (doc_id, hash of the text), a null id first, by ranges of ids: of each range the
first document is sent to the range before it as well, and what is sent in whole is sorted
and streamed, so no task holds more than two documents. Null texts count as empty, rows
that repeat follow one another, a single document is its own next one, and an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import over_tiles, tiled
from corpusloom.session import stored

SHINGLE = 5
BITS = 128
RADIUS = 6
#: Fingerprints that a key of a table may have on average, before tables get longer keys.
PER_KEY = 16
TILE = 1024
#: Rows compared with a tile at once.
ROWS = 256
#: Terms that vote at once.
BATCH = 1 << 16
#: Ranges of ids for each shuffle partition.
RANGES = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of one text: 16 bytes."""
    words = (text or "").encode().split()  # at exactly the white space of the contracts
    if not words:
        return bytes(BITS // 8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    number = max(1, len(words) - shingle + 1)
    counts = Counter([joined[a:b] for a, b in zip(starts[:number].tolist(), ends[-number:].tolist(), strict=True)])
    terms, weights = list(counts), np.array([n.bit_length() for n in counts.values()], np.int64)
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(terms), BATCH):
        digests = b"".join([hashlib.md5(t).digest() for t in terms[k : k + BATCH]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1)
        w = weights[k : k + BATCH]
        total += bits.sum(axis=0, dtype=np.int64) if w.max() == 1 else w @ bits
    return np.packbits(2 * total > weights.sum()).tobytes()


def differing(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated cosine of two texts' term vectors, from 0 to 1."""
    return round(max(0.0, math.cos(math.pi * differing(a, b) / BITS)), 6)


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


# --- neighbours --------------------------------------------------------------


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, guest, doc_id, tag, text): rows dealt by ranges of ids and sorted, each range followed by the first row of the next.

    The last range is followed by the first. Ends of ranges are quantiles of the ids, about as
    many as there are shuffle partitions; only they and the first row's key of each range reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    number = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.col("doc_id").cast("double")
    cuts = rows.agg(F.percentile_approx(place, [k / number for k in range(1, number)], 100 * number).alias("cuts")).first()["cuts"] or []
    ends = sorted(set(cuts))
    splits = [-math.inf, *ends, math.inf] if ends else [-math.inf, 0.0, math.inf]
    ranged = Bucketizer(splits=splits, inputCol="_place", outputCol="_range", handleInvalid="keep")
    # what is no number has the last bucket, and comes first
    rows = ranged.transform(rows.withColumn("_place", place)).withColumn("range", F.when(F.col("_place").isNull(), -1).otherwise(F.col("_range").cast("int"))).drop("_place", "_range")
    firsts = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct("doc_id", "tag")).alias("first")).collect())  # a row for each range
    before = [(at, firsts[k - 1][0], first["doc_id"], first["tag"]) for k, (at, first) in enumerate(firsts)]
    kind = docs.schema[doc_id].dataType.simpleString()
    guests = F.broadcast(spark.createDataFrame(before, f"range int, before int, _first {kind}, _tag long"))
    rows = rows.join(guests, "range")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    also = F.when(F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("tag") == F.col("_tag")), F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = rows.select("doc_id", "tag", "text", F.inline(also))
    order = ["range", "guest", "doc_id", "tag"]
    return rows.select(*order, "text").repartition("range").sortWithinPartitions(*order)


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every document."""
    rows = followed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            out = []
            for ident, guest, x in zip(b.column(2), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                if guest and held is None:  # the guest of a range repeats if its row does
                    continue
                fp = fingerprint(x, shingle)
                if held is not None:
                    own, before, held_fp = held
                    changed = edited(before, x)
                    changed_fp = fingerprint(changed, shingle)
                    out.append((own, len(before), hashlib.sha256(changed.encode()).hexdigest(), held_fp, changed_fp, likeness(held_fp, changed_fp), likeness(held_fp, fp)))
                held = None if guest else (ident, x, fp)
            if out:
                first, *rest = zip(*out, strict=True)
                yield pa.record_batch([pa.array([x.as_py() for x in first], schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:], strict=True)]], schema=schema)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double")


# --- search ------------------------------------------------------------------


def cuts(blocks: int) -> list[int]:
    return [BITS * k // blocks for k in range(blocks + 1)]


def intact_blocks(number: int, radius: int) -> int:
    """How many intact blocks make a key: the fewest with which keys have few fingerprints, at least one and at most three."""
    for intact in (1, 2):
        if number <= PER_KEY << (intact * (BITS // (radius + intact))):
            return intact
    return 3


def block_values(fp: np.ndarray, ends: list[int]) -> np.ndarray:
    """The bits of each block as a number: a column for each block."""
    bits = np.unpackbits(fp, axis=1).astype(np.int64)
    return np.stack([bits[:, p:q] @ (1 << np.arange(q - p)) for p, q in zip(ends, ends[1:])], axis=1)


class Tables:
    """The permuted tables for a radius: which blocks come first in each, and its keys."""

    def __init__(self, radius: int, intact: int) -> None:
        self.ends = cuts(radius + intact)
        self.block = -(-BITS // (radius + intact))
        self.wide = intact * self.block
        self.chosen = list(combinations(range(radius + intact), intact))
        if self.wide + len(self.chosen).bit_length() > 63:
            raise ValueError("the blocks are too wide for a key")

    def keys(self, blocks: np.ndarray, number: int) -> np.ndarray:
        key = np.full(len(blocks), number, np.int64)
        for i in self.chosen[number]:
            key = key << self.block | blocks[:, i]
        return key

    def first(self, key: int) -> tuple[int, ...]:
        """The blocks that come first in the table of a key."""
        return self.chosen[int(key) >> self.wide]


def tables(prints: DataFrame, own: Tables) -> DataFrame:
    """(key, fp, n): each of ``prints`` (fp, n) once in every table; a key is the table's number and the bits of its first blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            blocks = block_values(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8), own.ends)
            for t in range(len(own.chosen)):
                yield pa.record_batch([pa.array(own.keys(blocks, t)), b.column(0), b.column(1)], names=["key", "fp", "n"])

    return prints.select("fp", "n").mapInArrow(run, "key long, fp binary, n long")


def near_counts(prints: DataFrame, radius: int = RADIUS, intact: int | None = None, tile: int = TILE) -> DataFrame:
    """(fp, near) of distinct fingerprints (fp, n): how many documents have another fingerprint within ``radius``, where any has."""
    intact = intact or intact_blocks(prints.count(), radius)
    own = Tables(radius, intact)

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        whole = part["fp"].tolist()
        flat = b"".join(whole)
        words, n = np.frombuffer(flat, np.uint64).reshape(-1, 2), part["n"].to_numpy()
        blocks = block_values(np.frombuffer(flat, np.uint8).reshape(-1, BITS // 8), own.ends)
        mine = np.array(own.first(part["key"].iloc[0]))
        side = part["chunk"].to_numpy() if part["lo"].iloc[0] != part["hi"].iloc[0] else None
        total = np.zeros(len(part), np.int64)
        for at in range(0, len(part), ROWS):
            far = sum(np.bitwise_count(words[at : at + ROWS, None, k] ^ words[None, :, k]) for k in (0, 1))
            i, j = np.nonzero(far <= radius)
            i += at
            met = (i != j) if side is None else (side[i] != side[j])
            i, j = i[met], j[met]
            if not len(i):
                continue
            first = np.argsort(blocks[i] != blocks[j], axis=1, kind="stable")[:, :intact]  # the first equal blocks of a pair
            counted = (first == mine).all(axis=1)
            np.add.at(total, i[counted], n[j[counted]])
        found = np.flatnonzero(total)
        return pd.DataFrame({"fp": [whole[x] for x in found.tolist()], "near": total[found]}) if len(found) else None

    found = over_tiles(tiled(tables(prints, own), "key", "fp", tile), "key", work, "fp binary, near long")
    return found.groupBy("fp").agg(F.sum("near").alias("near"))


def fingerprint_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per document: its fingerprint and that of its edited text with their likenesses, class_id (the smallest id
    with an equal fingerprint) and n_near (other documents within ``radius``, copies included)."""
    rows = stored(compared(docs, doc_id, text, shingle), "prints")
    classes = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")), "classes")
    near = classes.join(near_counts(classes, radius), "fp", "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"))
    named = rows.join(stored(near, "near"), "fp")
    text_of = lambda c: F.lower(F.hex(c)).alias(c.replace("fp", "fingerprint"))
    return named.select("doc_id", "n_chars", "edited_sha256", text_of("fp"), text_of("edited_fp"), "near_edited", "near_next", "class_id", "n_near")
