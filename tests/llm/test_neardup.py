"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import neardup
from tests.llm.test_dedup import closure


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def table():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    common = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(3)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 30, 90, 200]))] + rnd.choice(["", *common]).split()
        for _ in range(rnd.randint(1, 5)):
            own = list(base)
            for _ in range(rnd.randint(0, len(own) // 25)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own + [rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, 6]))]))
    texts += [None, "", " \t", "one", "one", texts[0]]
    return list(enumerate(texts))


def test_near_copies(spark):
    """Links from 0.8 on, most of them more than 4 bits of a fingerprint apart."""
    rows = table()
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert sum(len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b]) for a, b in pairs) > 20
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    sides = neardup.TILE, neardup.SAMPLE, neardup.REPEATS
    want = set(closure(sorted(sets), pairs).values())
    for tile, sample, repeats in ((1024, 8, 4), (4, 1, 2)):
        neardup.TILE, neardup.SAMPLE, neardup.REPEATS = tile, sample, repeats
        try:
            got = corpus_pipeline.near_dedup_stage(spark, df, "")
            assert got.columns == df.columns
            assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
        finally:
            neardup.TILE, neardup.SAMPLE, neardup.REPEATS = sides
    assert corpus_pipeline.near_dedup_stage(spark, df.limit(0), "").count() == 0


def test_sketches_bound_the_difference():
    """Sketches, of equal or different widths, differ in no more bits than the sets in shingles, and in few less."""
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 31, 32, 33, 300, 5000):
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for extra in (0, 1, n // 10, n // 4):
            other = np.unique(np.concatenate([base[extra // 2 :], rnd.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            apart = len(np.setxor1d(base, other))
            got = neardup.bits_apart(neardup.parity(base), neardup.parity(other))
            assert got == neardup.bits_apart(neardup.parity(other), neardup.parity(base))
            assert apart / 2 <= got <= apart and got % 2 == apart % 2 or (apart < 8 and got <= apart)


def test_simhash_goes_first(spark):
    """The pairs that fingerprints give join the same sets as all fingerprints within the radius."""
    rows = table()
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, tag long, text string")
    got = neardup.prefixes(docs).cache()
    sims = {r["fp"]: r["sim"] & (1 << 64) - 1 for r in got.select("fp", "sim").collect()}
    pairs = [(a, b) for a in sims for b in sims if a < b and (sims[a] ^ sims[b]).bit_count() <= 4]
    found = [(r["a"], r["b"]) for r in neardup.simhash_pairs(got).collect()]
    assert pairs and all(a < b for a, b in found)
    assert closure(sorted(sims), found) == closure(sorted(sims), pairs)
