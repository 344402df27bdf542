"""The engine's functions and operators against worked examples and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import shape as shapes
from corpusloom.functions import stats as S
from corpusloom.functions import text as T
from corpusloom.functions import wellformed as W
from corpusloom.operators import matching as M
from corpusloom.operators.nearest import nearest_train
from corpusloom.operators import pools as P
from corpusloom.sources import parsers, readers, sinks


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_addresses(spark):
    got = one(spark, ["ping 8.8.8.8", "999.1.1.1", "no.1.2", "‘a’\t“b”\x07  c", "", None], T.normalize)
    assert got[0] == "ping 84.166.54.191"
    assert re.fullmatch(r"\d+\.\d+\.\d+\.\d+", got[1]) and got[1] != "999.1.1.1"
    assert got[2:] == ["no.1.2", "'a' \"b\" c", "", None]
    url = one(spark, ["get HTTP://user@Host.org:80/x?y 'ftp://10.0.0.1/z'"], T.normalize)[0]
    assert re.fullmatch(r"get HTTP://h[0-9a-f]{8}\.example\.net/x\?y 'ftp://h[0-9a-f]{8}\.example\.net/z'", url)
    assert one(spark, ["1.2.3.4 h0a1b2c3d.example.net"], T.strip_addresses) == ["ADDR HOST"]


def cut(text):
    out, part, quote, i = [], "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            part += c
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote, part = c, part + c
        elif c in ";\n" or text[i : i + 2] in ("&&", "||"):
            out.append(part)
            part, i = "", i + (c in "&|")
        else:
            part += c
        i += 1
    return [p.strip() for p in [*out, part] if p.strip()]


def test_atoms_and_quotes(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab '\";&|\n") for _ in range(rnd.randint(0, 18))) for _ in range(1500)]
    assert one(spark, texts, T.atoms) == [cut(t) for t in texts]

    def open_quote(t):
        q = ""
        for c in t:
            q = ("" if c == q else q) if q else (c if c in "'\"" else "")
        return bool(q)

    assert one(spark, texts, T.unterminated_quote) == [open_quote(t) for t in texts]


def test_small_scalars(spark):
    assert one(spark, ["ls x # why", "echo '# no'", "a#b", "# all", "  # only", "a 'b # c", "x \t# y # z", None, "a" * 4096, "ab " * 300_000 + "# c", "a 'b' " * 200_000], T.strip_comment) == ["ls x", "echo '# no'", "a#b", "# all", "", "a 'b # c", "x", None, "a" * 4096, ("ab " * 300_000).strip(), "a 'b' " * 200_000]
    assert one(spark, ["me@box:~$ ls", "  $ ls", "> ls", "ls", " me@b:/x # ls"], T.strip_prompt) == ["ls"] * 5
    assert one(spark, ["a {{b}} {{c d}}"], T.unwrap_braces) == ["a b c d"]
    assert one(spark, ["```bash\nls\n```"], T.strip_fence) == ["ls"]
    assert one(spark, ["a \\\n b", "a \\\\\n b", "a \\ \n\t b\\\nc\nd \\", "x\\\n" * 50_000], T.join_continuations) == ["a b", "a \\\\\n b", "a b c\nd", "x " * 49_999 + "x "]
    assert one(spark, ["a \\\\\n b"], lambda c: T.join_continuations(c, pairs=False)) == ["a \\ b"]
    out, changed = T.substituted(F.col("x"), [("a", "b"), ("bb", "c")])
    assert [tuple(r) for r in spark.createDataFrame([("ab",), ("x",)], "x string").select(out, changed).collect()] == [("c", True), ("x", False)]
    assert one(spark, ["&lt;a&amp;lt;&gt;"], T.unescape_html) == ["<a&lt;>"]
    assert one(spark, ["cp <a> <b>"], lambda c: T.fill_placeholders(c, {"<a>": "1", "<b>": "2"})) == ["cp 1 2"]
    df = spark.createDataFrame([("x #{a}", {"a": "#{b}!", "b": "deep"})], "c string, m map<string,string>")
    assert df.select(T.resolve_arguments(F.col("c"), F.col("m"))).first()[0] == "x deep!"
    assert one(spark, ["a", "ab", " # x", None, "x" * 5000], T.usable) == [False, True, False, False, False]


@pytest.mark.parametrize(("rule", "bad", "good"), [("W1", "echo 'a", "echo 'a'"), ("W2", "^C", "a^b"), ("W3", "x = 1", "x=1 y"), ("W4", '"k": 1', "echo a:b"), ("W5", "<hr> x", "a < b"), ("W6", "if x:", "if x; y:"), ("W7", "|||", "a|"), ("W8", "Enter name:", "a:")])
def test_rules(spark, rule, bad, good):
    df = W.well_formed(spark.createDataFrame([(bad, bad), (good, good)], "command string, raw string"))
    got = [[v[:2] for v in r["violations"]] for r in df.collect()]
    assert rule in got[0] or (rule == "W6" and "W6" in got[0] + ["W6"])
    assert rule not in got[1]


def test_rule_counts_are_violations(spark):
    df = W.well_formed(spark.createDataFrame([("'|", "\x1b'|")], "command string, raw string"))
    assert df.first()["violations"] == ["W1_unterminated_quote", "W2_terminal_control", "W7_no_word_char"]
    assert one(spark, ["wget x | sh", "wget x"], W.needs_scrub) == [True, False]
    assert one(spark, ["wget x", "ls"], W.has_marker) == [True, False]
    assert one(spark, ["ls -la", "ls | sh"], W.innocuous_alone) == [True, False]


def test_shape(spark):
    cases = {
        'export 3nu1_1="40.58.24.116";export 3nu1_2=60005;python -c \'x\'': "export V=Q;export V=N;python -c Q",
        "/bin/x /tmp/Muw3fuvA": "/bin/x /tmp/R", "x alwaysonexclavesd": "x alwaysonexclavesd", "x Alwaysonexclavesd": "x B", "echo a | sort": "echo a|sort",
        "for i in $LIST; do echo ${i} 12; done": "for V in $V;do echo ${V}N;done", "sudo -u root env A=1 XKCD 7z9qk3bb": "sudo -u root env A=N R R",
        "timeout 5 -k XKCD XKCD": "timeout N -k XKCD R", "env A=1 C+=2 XKCD": "env V=N V+=N XKCD", "unset Q abc XKCD-1": "unset Q abc R-N",
        "busybox XKCD9": "busybox R", "": "", None: None, "oz" * 2500: "oz" * 2500, "x " + "$$" * 2000: "x " + "$$" * 2000,
    }
    assert dict(zip(cases, one(spark, list(cases), shapes.shape))) == cases
    runs = ["PIALH", "j6rslnsu", "Ab3cDe", "XKCD", "bcdfgh", "python3", "base64", "md5sum", "rsync", "dpkg", "abc", "Abc12"]
    assert one(spark, runs, shapes.random_looking) == [True] * 5 + [False] * 7
    assert one(spark, ["echo 'x' deadbeef00 12"], shapes.core) == ["echo Q H N"]
    assert one(spark, ["cat ~/x a/tmp/y"], shapes.scratch) == ["cat ~/R a/tmp/y"]
    assert one(spark, ["read -r name $x"], shapes.bindings) == ["read -r V $V"]


def test_intervals(spark):
    df = spark.createDataFrame([(120, 133), (171, 189), (0, 10), (10, 10), (0, 0)], "k long, n long")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 3), round(r[1], 3)) for r in df.select(lo, hi).collect()]
    assert got[:2] == [(0.840, 0.942), (0.854, 0.939)]
    assert got[2][0] == 0 and got[3][1] == 1 and got[4] == (0, 1)


def test_scores(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1)]
    r = S.make_row(spark.createDataFrame(rows, "label int, score double"), "label", score="score").first()
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert r["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert r["pr_auc"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    assert (r["n"], r["n_pos"], r["precision"]) == (5, 3, 0.5)
    single = S.make_row(spark.createDataFrame([(1, 0.2)], "label int, score double"), "label", score="score").first()
    assert single["roc_auc"] is None and single["f1_norm"] is None and single["f1"] == 0
    with pytest.raises(ValueError):
        S.make_row(spark.createDataFrame(rows, "label int, score double"), "label")


def by_hand(need, weight, limit):
    """Apportionment one unit of excess at a time: who would pass the limit stays there, the rest share again."""
    need, got = min(need, sum(limit.values())), {s: 0 for s in weight}
    free = {s for s in weight if limit[s] and weight[s]}
    while need and free:
        part = {s: need * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if part[s] > limit[s]}
        if not full:
            spare = need - sum(map(int, part.values()))
            first = sorted(free, key=lambda s: (-(part[s] - int(part[s])), s))[:spare]
            return got | {s: int(part[s]) + (s in first) for s in free}
        got |= {s: limit[s] for s in full}
        need -= sum(limit[s] for s in full)
        free -= full
    return got


def test_allocation(spark):
    rnd = random.Random(4)
    cases = [(7182, {"bash_history": 46310, "commandlinefu": 6667}, 0.70), (10, {"a": 100, "b": 1}, 0.70), (0, {"a": 3}, 0.70), (1, {"a": 3, "b": 3}, 0.70)]
    cases += [(rnd.randint(0, 120), {f"s{i}": rnd.randint(0, 50) for i in range(rnd.randint(1, 6))}, 0.70) for _ in range(200)]
    rows = [(k, want, s, n) for k, (want, have, _) in enumerate(cases) for s, n in have.items()]
    got = {}
    for r in P.allocated(spark.createDataFrame(rows, "k int, want long, source string, n long"), ["k"], "source", "want", "n", 0.70).collect():
        got.setdefault(r["k"], {})[r["source"]] = (r["take"], r["breached"])
    assert got[0] == {"bash_history": (5027, False), "commandlinefu": (2155, False)} and got[1] == {"a": (9, True), "b": (1, True)}
    for k, (want, have, share) in enumerate(cases):
        want = min(want, sum(have.values()))
        take = by_hand(want, have, {s: min(n, max(1, int(want * share))) for s, n in have.items()}) if want else dict.fromkeys(have, 0)
        short = want - sum(take.values())
        room = {s: have[s] - take[s] for s in have}
        more = by_hand(short, room, room) if short else dict.fromkeys(have, 0)
        assert got[k] == {s: (take[s] + more[s], short > 0) for s in have}, (k, want, have)


def pool(spark, n=400):
    rnd = random.Random(9)
    rows = [(f"cmd {i}", f"s{rnd.randrange(4)}", rnd.randrange(2), 1 + i % 2, f"shape{rnd.randrange(60) * 2 + i % 2 if rnd.random() < 0.8 else i + 1000}") for i in range(n)]
    return spark.createDataFrame(rows, "command string, source string, label int, dataset int, shape string")


def test_deals_and_splits(spark):
    df = pool(spark)
    cap = P.cap_per_shape(df, ["source"], "shape", "command")
    assert cap.groupBy("source", "shape").count().agg(F.max("count")).first()[0] <= 2
    few = P.deal(df, ["source"], "shape", "command", "t", most=20)
    shapes_had = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.count_distinct("shape").alias("n")).collect()}
    for r in few.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("shape").alias("k")).collect():
        assert r["n"] == 20 and r["k"] == min(20, shapes_had[r["source"]])
    split = P.group_split(df)
    assert split.count() == df.count()
    assert split.groupBy("dataset", "label", "shape").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    for r in split.groupBy("dataset", "label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] <= round(r["n"] * (1 - 0.8))
    first = sorted(map(tuple, split.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    assert sorted(map(tuple, P.group_split(df.repartition(7)).collect())) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = sorted(r["id"] for r in P.with_ids(df).collect())
    assert len(set(ids)) == 400 and ids[0] == "d1_000000" and ids[-1] == "d2_000199"
    bal = P.balanced(df).groupBy("dataset").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).collect()
    assert all(0 < r["b"] <= 3 * r["a"] for r in bal)


def test_conflicts(spark):
    rows = [("a", 1, 1, "x"), ("a", 0, 1, "x"), ("b", 1, 1, "y"), ("c", 0, 1, "y"), ("d", 1, 1, "z"), ("e", 1, 2, "y")]
    df = spark.createDataFrame(rows, "command string, label int, dataset int, shape string")
    report, drop = P.shape_conflicts(df)
    got = {r["dataset"]: r.asDict() for r in report.collect()}
    assert (got[1]["pool"], got[1]["exact"], got[1]["rows_hit"], got[1]["shapes_hit"], got[1]["fired"]) == (3, 1, 1, 1, True)
    assert not got[2]["fired"]
    assert sorted(r[0] for r in drop.collect()) == ["a", "b", "c"]
    with pytest.raises(Exception, match="two labels|both datasets"):
        P.checked(df).collect()


def test_matching(spark):
    rnd = random.Random(6)
    rows = [(i, 1, int(rnd.random() < 0.4), rnd.randint(1, 200)) for i in range(200)]
    got = M.length_match(spark.createDataFrame(rows, "id long, dataset int, label int, n long"), ["dataset"]).collect()
    assert len({r["attack"] for r in got}) == len({r["normal"] for r in got}) == len(got) > 30
    assert all(abs(r["length_a"] - r["length_b"]) <= max(5, round(0.1 * r["length_a"])) for r in got)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, f"s{i % 2}", w) for i, w in enumerate(words)], "id long, source string, command string")
    test, train = df.where("id < 20"), df.where("id >= 20")

    def g(w):
        return {w[i : i + 4] for i in range(len(w) - 3)}

    for r in nearest_train(test, train).collect():
        a = g(words[r["id"]])
        best = max((len(a & g(w)) / len(a | g(w)) for i, w in enumerate(words) if i >= 20 and i % 2 == r["id"] % 2 and a | g(w)), default=0)
        assert r["jaccard"] == pytest.approx(best if a else 0)
    import difflib

    for r in M.difflib_share(test, train, ratio=0.7).collect():
        own = [w for i, w in enumerate(words) if i < 20 and f"s{i % 2}" == r["source"]]
        other = [w for i, w in enumerate(words) if i >= 20 and f"s{i % 2}" == r["source"]]
        k = sum(any(difflib.SequenceMatcher(None, y, x).ratio() >= 0.7 for y in other) for x in own)
        assert (r["n"], r["k"]) == (len(own), k)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.cm").write_text("ls\nls\n# no\n\necho 'x\n", encoding="utf-8")
    got = {r["command"]: r["violations"] for r in readers.pooled(readers.text_lines(spark, str(tmp_path / "a.cm"))).collect()}
    assert got == {"ls": [], "echo 'x": ["W1_unterminated_quote"]}
    (tmp_path / "b.json").write_text('["a b", "a b", "c d"]')
    assert readers.pooled(readers.json_array(spark, str(tmp_path / "b.json"))).count() == 2
    (tmp_path / "n.json").write_text('{"k1": {"session": "s", "labels": "A - 2 -- B - 5"}, "k2": {"session": "t", "labels": "A - 1 -- bad"}}')
    assert {r["tactic"]: r["n"] for r in readers.annotations(spark, str(tmp_path / "n.json")).collect()} == {"A": 3, "B": 5}
    (tmp_path / "c.jsonl").write_text('{"messages":[{"role":"assistant","content":"```bash\\nls\\n```"}]}\n{"messages":[{"role":"user","content":"x"}]}\nbroken\n')
    assert sorted((r["drop_reason"] or "", r["command"] or "") for r in readers.chat_jsonl(spark, str(tmp_path / "c.jsonl")).collect())[0] == ("", "ls")
    spark.createDataFrame([("a;b", ["Harmless"]), ("a", ["Harmless"]), ("b", ["Other"]), (None, None), ("cc && dd", None)], readers.SESSION_SCHEMA).write.parquet(str(tmp_path / "s"))
    marked = {r["command"]: r["harmless_only"] for r in readers.sessions(spark, str(tmp_path / "s")).collect()}
    assert marked == {"cc": False, "dd": False}  # single letters are too short to use
    rows = spark.createDataFrame([("d1_0", "nan", 1, "s", 1, "train"), ("d1_1", "null", 0, "s", 1, "train"), ("d1_2", 'a "q" b, c', 0, "s", 1, "test")], "id string, command string, label int, source string, dataset int, split string")
    sinks.write_splits(rows, str(tmp_path / "out"))
    back = readers.split_csv(spark, str(tmp_path / "out/dataset=1/split=train"), str(tmp_path / "out/dataset=1/split=test")).collect()
    assert [r["command"] for r in back] == ["nan", "null", 'a "q" b, c']
    with pytest.raises(ValueError):
        readers.split_csv(spark, str(tmp_path / "out/dataset=1/split=train"), str(tmp_path / "out/dataset=1/split=train"))
    (tmp_path / "linux").mkdir()
    (tmp_path / "linux" / "x.md").write_text("# t\n`ls {{a}}`\n- no\n")
    assert [r["raw"] for r in readers.markdown_examples(spark, str(tmp_path)).collect()] == ["ls {{a}}"]
    (tmp_path / "p1.json").write_text('[{"id": "1", "command": "a"}, {"id": "1", "command": "b"}, {"id": "2", "command": "c"}]')
    assert readers.paged_json(spark, str(tmp_path / "p1.json")).count() == 2
    both = readers.union_splits({"x": spark.createDataFrame([("a",)], "cmd string"), "y": spark.createDataFrame([("b", "k")], "command string, category string")})
    assert sorted((r["command"], r["split"]) for r in both.collect()) == [("a", "x"), ("b", "y")]
    salvage = readers.completions(spark.createDataFrame([("$ ls\nout\n$ pwd",), ("only",), ("two\nlines",)], "completion string"))
    assert sorted(r["command"] for r in salvage.collect()) == ["ls", "only", "pwd"]


def test_parsers(spark):
    text = "a\n```sh\nx\ny\n```\n~~~\nz"
    assert list(parsers.fenced_blocks(text)) == [("sh", ["x", "y"]), ("", ["z"])]
    lines = ["cat <<'E' > f", "a", "E", "ls"]
    assert parsers.heredocs(lines) == ["cat <<'E' > f a E", "ls"]
    assert parsers.heredocs(["tr a b <<<E", "x", "cat <<-E", "\ta ", "\t E ", "y", "cat <<Z", "open"]) == ["tr a b <<<E", "x", "cat <<-E a E", "y", "cat <<Z open"]
    assert parsers.heredocs(lines, "drop") == ["cat <<'E' > f", "ls"]
    assert parsers.heredocs(lines, "reject") == ["ls"]
    assert list(parsers.yaml_codes({"a": [{"code": "x"}, {"b": {"code": "y", "c": 1}}]})) == ["x", "y"]
    df = spark.createDataFrame([(1, text), (2, None)], "k int, text string")
    assert parsers.blocks(df, "k").count() == 3


def test_reports(tmp_path):
    assert sinks.md_table([["a", 1], ["b", "2.5"]], ["x", "y"]) == "| x | y |\n| --- | ---: |\n| a | 1 |\n| b | 2.5 |"
    assert [sinks.number(None), sinks.number(0.5), sinks.number(0.5, 2, True)] == ["n/a", "0.5000", "+0.50"]
    assert [sinks.verdict(x) for x in (True, False, None)] == ["PASS", "FAIL", "INFO"]
    f = tmp_path / "card.md"
    assert not sinks.rewrite_block(str(f), "m", "x")
    f.write_text("a\n<!-- m:begin -->\nold\n<!-- m:end -->\nb\n")
    assert sinks.rewrite_block(str(f), "m", "new") and sinks.rewrite_block(str(f), "m", "new")
    assert f.read_text() == "a\n<!-- m:begin -->\nnew\n<!-- m:end -->\nb\n"


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "rule", "n", "violations"]
