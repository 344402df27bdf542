"""Tiles of test and train texts: what is counted, what is shipped."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tiles
from corpusloom.operators.nearest import nearest_train


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("crowded, repeats", [(0, True), (2, False), (10**6, True)])
def test_shared_pieces(n, crowded, repeats):
    rnd = random.Random(n)
    texts = ["", "a", "\U0010ffff" * 9] + ["".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    a, b = texts[:20], texts[20:] + texts[:3]
    bags = [[Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in side] for side in (a, b)]
    if not repeats:
        bags = [[Counter(set(c)) for c in side] for side in bags]
    both, own, other = tiles.shared(a, b, n, crowded, repeats)
    assert both.tolist() == [[(x & y).total() for y in bags[1]] for x in bags[0]]
    assert own.tolist() == [x.total() for x in bags[0]] and other.tolist() == [y.total() for y in bags[1]]


def test_a_round_ships_what_follows_the_input(spark, monkeypatch):
    """Sixteen parts meet sixteen in rounds; each text is in the search, and no written table holds gram sets."""
    rnd = random.Random(1)
    rows = [(i, "g", "".join(rnd.choice("abcd") for _ in range(60)), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source string, command string, test boolean")
    written = []
    keep = tiles.stored

    def watched(d, name):
        out = keep(d, name)
        written.append((name, set(out.columns), out.count()))
        return out

    monkeypatch.setattr(tiles, "stored", watched)
    got = {r["id"]: r["jaccard"] for r in nearest_train(df.where("test"), df.where("not test"), grams=750).collect()}
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for _, _, t, _ in rows]
    for i in range(0, 400, 40):
        assert got[i] == pytest.approx(max(len(grams[i] & y) / len(grams[i] | y) for y in grams[1::2]))
    assert sum(name == "best" for name, _, _ in written) > 1
    assert all(count <= 400 and not columns & {"a", "gram"} for name, columns, count in written)


@pytest.mark.parametrize("before, after", [(0, 0), (3, 0), (2, 7), (50, 50)])
def test_shared_pieces_within_reach(before, after):
    """No fewer than can be paired within the reach, and exactly those where it is none."""
    rnd = random.Random(before)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(16)]
    a, b = texts[:8], texts[8:] + texts[:2]
    both = tiles.shared(a, b, 2, 3, True, (before, after))[0]
    for x, row in zip(a, both, strict=True):
        for y, k in zip(b, row, strict=True):
            left = Counter((y[j : j + 2], j) for j in range(len(y) - 1))
            pairs = 0
            for i in range(len(x) - 1):  # places grow, so the earliest that is left is right
                j = next((j for j in range(max(0, i - before), min(len(y) - 1, i + after + 1)) if left[x[i : i + 2], j]), None)
                if j is not None:
                    left[x[i : i + 2], j] = 0
                    pairs += 1
            assert pairs <= k
    if (before, after) == (0, 0):
        assert all(k == sum(x[i : i + 2] == y[i : i + 2] for i in range(min(len(x), len(y)) - 1)) for x, row in zip(a, both, strict=True) for y, k in zip(b, row, strict=True))


def test_guards_ask_what_the_patterns_asked(spark):
    from corpusloom.functions import text as T

    blanks = r" {2}|[\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    rows = spark.range(1, 0x3100).select(F.concat(F.lit("aé b"), F.decode(F.encode(F.from_json(F.format_string('["\\u%04x"]', "id"), "array<string>")[0], "utf-8"), "utf-8"), F.lit("c")).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([("a  b",), ("a b",), ("",), ("\t",), ("  ",)], "t string"))
    t = F.col("t")
    differ = rows.where((T.has_runs(t) != t.rlike(blanks)) | (T.unclean(t) != t.rlike(rf"[\x00-\x1f\x7f{T.SMART_QUOTES}]")))
    assert rows.where(T.has_runs(t)).count() > 20 and differ.count() == 0


def test_fingerprint_is_asked_of_labelled_rows_alone(spark, tmp_path, monkeypatch):
    from corpusloom.plans import base as B

    spark.createDataFrame([(i, f"ls /tmp/x{i}\nid", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    written, keep = [], B.stored

    def watched(d, name):
        out = keep(d, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(B, "stored", watched)
    got = {(r["command"], r["doc_id"], r["label"]) for r in B.labelled(spark, str(tmp_path)).collect()}
    assert got == {("ls /tmp/x0", 0, 1), ("id", 0, 1), ("ls /tmp/x4", 4, 0)}
    assert written == [3]
