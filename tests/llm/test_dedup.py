"""Near-dedup operators against brute force."""

import random

import numpy as np
import xxhash

from corpusloom.llm import embeddings, simhash
from corpusloom.llm.common import components


def closure(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rnd = random.Random(3)
    chain = list(range(0, 300))
    rnd.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(1000, k) for k in range(1001, 1200)] + [(5000 + rnd.randrange(300), 5000 + rnd.randrange(300)) for _ in range(150)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs for x in p}
    want = closure(ids, pairs)
    assert all(got.get(i, i) == want[i] for i in ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    rnd = random.Random(5)
    words = [f"W{i}é" for i in range(300)]
    rows = []
    for g in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 400))]
        for _ in range(rnd.randint(1, 4)):
            own = list(base)
            if rnd.random() < 0.7:
                own[rnd.randrange(len(own))] = "changed"
            rows.append((len(rows), " \n".join(own)))
    rows += [(900, None), (901, ""), (902, "\t \n"), (903, "ONE"), (904, "one"), (None, "one"), (None, "alone in the world of ids"), (905, rows[0][1]), (905, rows[0][1])]
    got = simhash.simhash_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = [slow_fingerprint(t) for _, t in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((d is None, d or 0, f"{f:016x}") for (d, _), f in zip(rows, want))
    n = len(rows)
    comp = closure(range(n), [(i, j) for i in range(n) for j in range(i) if bin(want[i] ^ want[j]).count("1") <= 4])
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[i][0])
    expected = sorted((str(rows[i][0]), str(least.get(comp[i]))) for i in range(n))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == expected
    kept = simhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert kept.count() == len(set(comp.values()))


def test_simhash_tiles(spark):
    """A crowded bucket, dealt into many tiles, keeps its component."""
    rnd = random.Random(8)
    base = rnd.getrandbits(62)
    prints = sorted({base ^ (1 << rnd.randrange(62)) ^ (1 << rnd.randrange(62)) for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["id"]: r["component"] for r in components(simhash.links(df, tile=16)).collect()}
    want = closure(prints, [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4])
    assert {p: got.get(p, p) for p in prints} == want


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.15])).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]), (2002, None, 1), (2003, [0.0] * 64, 1), (2004, [float("nan")] * 64, 1), (2005, rows[1][1], None), (2006, [1.0, None], 1), (2007, [], 1), (2008, [1.0, 2.0], 1), (2009, [1.0, 2.1], 1), (2010, [-0.0, 2.0], 2), (2011, [0.0, 2.0], 2)]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    sides = embeddings.PER_PIVOT, embeddings.TILE
    embeddings.PER_PIVOT, embeddings.TILE = 20, 32
    try:
        got = {r["vec_id"]: r for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    finally:
        embeddings.PER_PIVOT, embeddings.TILE = sides
    sound = {}
    for i, v, l in rows:
        if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v, np.float32).astype(float)
            sound[i] = (a / np.linalg.norm(a), l)
    pairs = [(a, b) for a in sound for b in sound if a < b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98]
    comp = closure([r[0] for r in rows], pairs)
    assert len(pairs) > 50 and len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["n_links"] == sum(i in p for p in pairs)
        assert got[i]["component_id"] == comp[i]
        assert got[i]["kept"] == (comp[i] == i)
    named = spark.createDataFrame([("b", [1.0, 1e300], "x:1"), ("a", [2.0, 2e300], "x:1"), ("c", [1e-300, 1.0], "x:1"), (None, [1.0, 0.0], "x:1")], "vec_id string, embedding array<double>, label string")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_dedup(named).collect()} == {"a": (2, "a", True), "b": (2, "a", False), "c": (2, "a", False), None: (0, None, True)}
    assert embeddings.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
