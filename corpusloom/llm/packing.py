"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised where they lie and only piece descriptions move. Pieces of
equal length are interchangeable, so best-fit decreasing needs nothing but the number
of pieces of each length: at most ``capacity`` numbers, whatever the corpus. They are
packed on the driver, longest first, with a segment tree over remaining capacities
that finds the tightest open bin in logarithmic time; bins of equal remaining space
are handled as one group. The outcome is a list of runs: pieces of a length with ranks
in a range go to a range of sequences. Its size depends on the capacity, not on the
corpus. Every piece then looks up its rank, a prefix sum over hash buckets, so a length
that most documents share is spread over all tasks. This is exactly the packing that
best-fit decreasing of all pieces in one list gives.

Null texts count as empty: a single end token. Repeated rows are packed as documents of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

CAPACITY = 4096
END = 1
#: Pieces of a length that are ranked together (about), and the least number of buckets.
BUCKET_ROWS = 1 << 16
BUCKETS = 64
#: Entries that a worker's word caches hold before they start anew.
CACHE = 500_000


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Ids of a word-level BPE file, as the tokenizers library gives them, with caches.

    Its tokens never cross white space, so a text's ids are those of its words. Words
    of Latin letters are split and looked up piece by piece; any other word goes to the
    library as it is.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.plain = regex.compile(r"[\x21-\x7e\xa1-įı-ſ]+").fullmatch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.simple = regex.compile(r"[^ \t\n\r\x0b\x0c]+").findall
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        spare = iter(range(256, 512))
        self.byte = [chr(b) if b in shown else chr(next(spare)) for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            mapped = piece if piece.isascii() else "".join([self.byte[b] for b in piece.encode()])
            got = _packed([t.id for t in self.model.tokenize(mapped)])
            if len(piece) < 40:
                self.parts[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece, which need not be kept apart from its word
            return self._kept(word, _packed([t.id for t in self.model.tokenize(word.lower())]))
        if self.plain(word) and "<|" not in word:
            got = b"".join([self._part(p) for p in self.pieces(word.lower())])
        else:
            got = _packed(self.whole.encode(word, add_special_tokens=False).ids)
        return self._kept(word, got)

    def _kept(self, word: str, got: bytes) -> bytes:
        if len(word) < 40:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        known = self.words.get
        words = self.simple(text) if self.odd(text) else text.split()
        return b"".join([known(w) or self._word(w) for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer of a file; kept, as Python workers are reused."""
    return _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32[, ids])."""

    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end, step = np.array([END], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out, rows = [], []
            for d, x in enumerate(batch.column("text").to_pylist()):
                raw = (t.ids(x) if x else b"") + end
                for k, at in enumerate(range(0, len(raw), step)):
                    own = raw[at : at + step]
                    rows.append(d)
                    out.append((k, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int64)] if with_ids else [])))
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            own_ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.record_batch([own_ids, *[pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)]], names=["doc_id", *[n for n, _ in kinds]])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds groups (first sequence, number) of open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _count(self, left: int, change: int) -> None:
        k = left + self.size
        while k:
            self.open[k] += change
            k >>= 1

    def push(self, left: int, first: int, number: int) -> None:
        if number and left:
            self.groups[left].append((first, number))
            self._count(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._count(left, -1)
        return self.groups[left].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` with an open bin."""
        k = length + self.size
        if self.open[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, number, pieces a bin, first sequence, offset), and the number of sequences.

    Pieces of one length fill the tightest bin as often as they fit before they take the
    next, which is what best fit does one by one.
    """
    tree, runs, used = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, used, -(-left // (capacity // length))
                used += bins
            else:
                first, bins = tree.pop(room)
            each = room // length
            full = min(bins, left // each)
            for n, per in ((full, each), (1, left - full * each)) if full < bins else ((full, each),):
                if n and per:
                    runs.append((length, rank, n * per, per, first, capacity - room))
                    tree.push(room - per * length, first, n)
                    rank, left, first, bins = rank + n * per, left - n * per, first + n, bins - n
            tree.push(room, first, bins)
    return runs, used


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``found`` should be a written table."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = best_fit_decreasing(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    base = np.int64(1) << 40
    keys = table[:, 0] * base + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = table[np.searchsorted(keys, length * base + rank, "right") - 1]
            k = rank - run[:, 1]
            own = [b.column(c) for c in names]
            yield pa.record_batch([*own, pa.array(run[:, 4] + k // run[:, 3]), pa.array(run[:, 5] + k % run[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    names = found.columns
    buckets = max(BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    rows = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.join(sums, ["length", "_bucket"]).select(*names, (F.col("_base") + own - 1).alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``; with ``with_ids`` each piece carries its ids."""
    return pack(stored(pieces(docs, path, doc_id, text, capacity, with_ids), "pieces"), capacity)
