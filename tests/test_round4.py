"""Rule banks against their SQL on accented letters; the fingerprint with and without its short path."""

import random

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.functions import shape as shapes
from corpusloom.llm import packing
from corpusloom.llm.queries import tokenizer_path


def against_sql(spark, tmp_path, name, rows, schema="doc_id long, text string, lang string, source string"):
    """Rows of a query and of its SQL over a small table of documents."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(plans.ORACLE[name])
    names = [c[0] for c in found.description]
    wanted = [tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall()]
    return sorted(map(tuple, got.collect()), key=repr), sorted(wanted, key=repr)


@pytest.mark.parametrize("name", ["q_bank_book", "q_bank_technique", "q_bank_sheet", "q_bank_history"])
def test_rule_banks_end_a_word_where_the_sql_does(spark, tmp_path, name):
    texts = ["doñadoque. | cióna", "if doíado, Elñja", "for asído ído", "if x Ñdo\nfié", "netü use", "École x y...", "éATTACKER à", "a été..."]
    got, wanted = against_sql(spark, tmp_path, name, [(44 * i + k, t, "es", "s") for i, t in enumerate(texts) for k in range(44)])
    assert got == wanted


def test_segments_that_begin_with_a_command_need_no_fold(spark):
    r = random.Random(4)
    words = ["sudo", "env", "export", "A=1", "x+=b", "-u", "root", "nice", "10", "ls", "/usr/bin/env", "/tmp/abc1", "for", "i", "in", "$x", "'a b'", "deadbeef99", "a1B2c3D4", "BCDFGH", "ABC1", "foo=bar", "declare", "é9", "QUJDREVGR0hJSktM==", "time", "if", "\u0663\u0663"]
    commands = ["".join(x for _ in range(r.randint(0, 9)) for x in (r.choice(words), r.choice([" ", " ", "  ", ";", " | ", "&&", "\n", "$(", "}"]))) for _ in range(3000)]
    rows = spark.createDataFrame([(c,) for c in [*commands, "", None]], "c string")
    both = rows.select("c", shapes.shape(F.col("c")).alias("a"), shapes.shape(F.col("c"), shapes.folded).alias("b"))
    assert not both.where("not a <=> b").take(3)


def test_the_fingerprint_folds_no_plain_command(spark):
    rows = spark.createDataFrame([("cp zq1B2c3D4 b",)], "c string")
    fail = lambda segment: F.raise_error(F.lit("folded"))
    own, shapes.folded = shapes.folded, fail
    try:
        assert rows.select(shapes.shape(F.col("c"))).first()[0] == "cp R b"
    finally:
        shapes.folded = own


def test_a_word_of_letters_is_kept_once_and_has_the_library_s_ids():
    t = packing.WordTokenizer(tokenizer_path())
    words = ["Hello", "strngthq", "ABC", "x1", "ciónlloc,", "don't", "a" * 50, "ſ", "K", "<|im_end|>"]
    for w in words * 2:
        assert np.frombuffer(t.ids(w), "<u4").tolist() == t.whole.encode(w, add_special_tokens=False).ids
    t = packing.WordTokenizer(tokenizer_path())
    t.ids("Hello strngthq")
    assert len(t.words) == 2 and not t.parts
