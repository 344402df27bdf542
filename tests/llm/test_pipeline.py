"""The pipeline against a slow version in plain Python and DuckDB, stage by stage."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.session import stored
from tests.llm.test_dedup import closure
from tests.llm.test_lines import slow
from tests.llm.test_text_ops import fill

SPACE = r"[^\x20\x09-\x0D]+"


def five(text):
    """The set of five-word shingles; of fewer words, all of them."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def table(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 40)))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(70):
        body = [line() for _ in range(4)] + ([rnd.choice(shared)] if rnd.random() < 0.4 else [])
        rows.append((i, "\n".join(body), "en", rnd.choice(["a", "b", "b", "b"]), 1))
    for i in range(6):  # copies, near-copies and junk
        rows.append((100 + i, rows[i][1], "en", "a", 1))
        rows.append((200 + i, rows[i + 10][1] + " tail", "en", "b", 1))
        own = line().split()
        rows.append((300 + i, " ".join(["same words again"] * 40), "en", "a", 1))
        rows.append((400 + i, " ".join(x + "###" for x in own * 4), "fr", None, 1))
    rows += [(500, None, "en", "a", 0), (501, "", None, None, None), (502, "short", "en", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = table(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, after = docs.columns, {}
    for name in list(stages)[:-1]:
        docs = stored(stages[name](spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "mixing":
            mixed = docs.collect()

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = {r[0] for r in con.sql(f"select doc_id from ({queries.ORACLE['op10_quality_rules']}) where kept").fetchall()}
    text = {r[0]: r[1] for r in rows}
    assert after["quality"] == {i: text[i] for i in kept} and not any(i >= 300 for i in kept)

    drops = slow(sorted(after["quality"].items()))
    want = {}
    for i, t in after["quality"].items():
        lines = [x for k, x in enumerate(t.split("\n")) if k not in drops.get((i, t), [])]
        if (i, t) not in drops:
            want[i] = t
        elif re.search(SPACE, "\n".join(lines)):
            want[i] = "\n".join(lines)
    assert after["lines"] == want and len(want) < len(after["quality"])

    sets = {i: five(t) for i, t in want.items()}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    groups = closure(sorted(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    assert set(after["near_dedup"]) == set(groups.values())

    size = lambda t: len(re.findall(SPACE, t or ""))
    source = {r[0]: r[3] for r in rows}
    sizes, taken = {}, {}
    for i, t in after["near_dedup"].items():
        sizes[source[i]] = sizes.get(source[i], 0) + size(t)
    for r in mixed:
        assert after["near_dedup"][r["doc_id"]].split()[: size(r["text"])] == r["text"].split()
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    target = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))})
    assert all(abs(taken[s] - target[s]) <= 4 for s in sizes)

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted({r["doc_id"] for r in mixed})
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    keep = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert keep(whole) == keep(packed)
