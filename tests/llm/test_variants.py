"""Spelling variants, fingerprints and centroid clustering against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import clustering, fingerprints, spelling

# --- spelling ----------------------------------------------------------------


def slow_words(rows):
    seen = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = base[min(rnd.randrange(60), rnd.randrange(60))]
            p = rnd.randrange(len(w))
            words.append(rnd.choice([w, w, w.upper(), w[:p] + w[p + 1 :], w[:p] + rnd.choice("abcÿ") + w[p:], w[:p] + rnd.choice("abc") + w[p + 1 :]]))
        rows.append((k, rnd.choice([" ", "-", "1"]).join(words)))
    rows += [(500, None), (501, ""), (None, "nullid nullid nullid"), (502, "ÉCOLE École école eCOLE"), (7, rows[7][1]), (503, "aaaaaa " * 4 + "aaaaa " * 9), (504, "qwert " * 30 + "qwerty " * 12 + "qwertyu " * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {tuple(r) for r in spelling.variant_report(docs).collect()}
    want = slow_variants(slow_words(rows))
    assert got == want and len(want) > 100
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms
    assert spelling.variant_report(docs.limit(0)).count() == 0


def test_spelling_groups_hold_no_pairs(spark):
    """A place in which every letter occurs: each of its words has the others as near words."""
    words = spark.createDataFrame([(f"word{chr(97 + i)}", 3 + i) for i in range(26)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(words).collect()}
    assert all(n == 25 for _, _, n in got.values()) and got["worda"][:2] == ("wordz", "wordz") and got["wordz"][:2] == (None, "wordz")


# --- fingerprints ------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    terms = Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    votes = [0] * 128
    for t, n in terms.items():
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        for b in range(128):
            votes[b] += len(f"{n:b}") * (1 if h >> (127 - b) & 1 else -1)
    return "".join("1" if v > 0 else "0" for v in votes)


def test_fingerprints(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(60):
        words = [rnd.choice(["one", "two", "three", "é", "あ", "long" * 9]) + str(rnd.randrange(60)) for _ in range(rnd.choice([1, 3, 5, 6, 40, 300]))]
        text = rnd.choice([" ", "\n", "\t "]).join(words)
        rows += [(k * 3 + j, text if j < 2 else text.replace("one", "One", 1)) for j in range(rnd.randint(1, 3))]
    rows += [(-5, None), (900, ""), (901, " \n"), (902, "a"), (903, "word " * 4000)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, "z", "q", 1) for r in rows], "doc_id long, text string, tag string, fp string, guest int")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).collect()}
    order = sorted(rows)
    prints = {i: slow_fingerprint(t) for i, t in order}
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    like = lambda a, b: round(max(0, math.cos(math.pi * differ(a, b) / 128)), 6)
    for k, (i, text) in enumerate(order):
        j, after = order[(k + 1) % len(order)]
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own = slow_fingerprint(changed)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert int(r["fingerprint"], 16) == int(prints[i], 2) and int(r["edited_fingerprint"], 16) == int(own, 2) and len(r["fingerprint"]) == 32
        assert (r["near_edited"], r["near_next"]) == (like(prints[i], own), like(prints[i], prints[j]))
        assert r["n_near"] == sum(differ(prints[i], prints[m]) <= fingerprints.RADIUS for m, _ in order) - 1
        assert r["class_id"] == min(m for m, _ in order if prints[m] == prints[i])
    assert len(got) == len(rows)


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint_report(spark.createDataFrame([], schema)).count() == 0
    alone = fingerprints.fingerprint_report(spark.createDataFrame([(4, "only one text")], schema)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["n_near"] == 0
    rows = [(None, "b"), (None, "a"), (1, "a"), (1, "a"), (1, "c d e f g h"), (1, "a")]
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and sorted(r["n_near"] for r in got) == [0, 0, 3, 3, 3, 3]


@pytest.mark.parametrize("radius, intact", [(6, 1), (6, 2), (3, 2), (9, 3), (12, 1)])
def test_permuted_tables_count_every_pair_once(spark, radius, intact):
    rnd = np.random.default_rng(radius)
    base = rnd.integers(0, 256, (12, 16), dtype=np.uint8)
    prints = {b.tobytes() for b in base}
    for b in base:
        for _ in range(60):
            bits = np.unpackbits(b)
            bits[rnd.choice(128, rnd.integers(1, radius), replace=False)] ^= 1
            prints.add(np.packbits(bits).tobytes())
    rows = [(bytearray(p), int(rnd.integers(1, 4))) for p in sorted(prints)]
    got = {bytes(r["fp"]): r["near"] for r in fingerprints.near_counts(spark.createDataFrame(rows, "fp binary, n long"), radius, intact, tile=20).collect()}
    for p, _ in rows:
        assert got.get(bytes(p), 0) == sum(n for q, n in rows if q != p and fingerprints.differing(bytes(p), bytes(q)) <= radius)


# --- clustering --------------------------------------------------------------


def slow_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    centroids = [e for _, e in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda e: min((square(e, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        taken = [nearest(e)[1] for _, e in kept]
        for j in set(taken):
            own = [e for (_, e), t in zip(kept, taken) if t == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(e) for _, e in kept]
    total = sum(d for d, _ in last)
    return sorted(((i is not None, i or 0, j, d, sum(x for x, y in last if y == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)))


@pytest.mark.parametrize("heads, spread", [(16, 0.05), (3, 0.3), (40, 1.5)])
def test_centroid_clustering(spark, heads, spread):
    rnd = np.random.default_rng(heads)
    middle = rnd.normal(size=(heads, 64))
    rows = [(i, (middle[i % heads] + spread * rnd.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(900 + i, [float(i % 2)] * 64) for i in range(30)]  # ties and repeated vectors
    rows += [(1000, None), (1001, [0.0] * 63), (1002, [None] + [0.0] * 63), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, []), (None, [0.25] * 64), (5, rows[5][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, v int, cluster string").repartition(5)
    got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, *r[1:]) for r in clustering.cluster_report(table).collect())
    assert got == slow_clusters(rows)


def test_bounds_pass_over_most_distances(spark):
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(16, 64)) * 4
    rows = [(i, (middle[i % 16] + 0.1 * rnd.normal(size=64)).tolist()) for i in range(800)]
    out, _ = clustering.yinyang(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    scanned = sum(r["scanned"] for r in out.select("scanned").collect())
    assert 16 * 800 <= scanned < 0.7 * 16 * 4 * 800


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster_report(spark.createDataFrame([], schema)).count() == 0
    few = clustering.cluster_report(spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], schema)).collect()
    assert sorted(r["distance"] for r in few) == [0, 0]
