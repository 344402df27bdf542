"""Readers of YAML, books and sessions."""

import pytest

from corpusloom.operators import pools as P
from corpusloom.session import qualified
from corpusloom.sources import parsers, readers, sinks, yamlish

GOOD = [
    ("a: 1\nb: two\nc:\n", {"a": 1, "b": "two", "c": None}),
    ("---\n# note\na:\n- x\n- 'it''s'\n-\n  k: \"q\\n\\x41\"\n...\nrest", {"a": ["x", "it's", {"k": "q\nA"}]}),
    ("a: |\n  one\n    two\n\n  three\n\nb: >-\n  f\n  g\n\n  h\n   i\n  j\n", {"a": "one\n  two\n\nthree\n", "b": "f g\nh\n i\nj"}),
    ("a: |2-\n    x\n   y\nb: |+\n  z\n\nc: [1, 'b c', {d: e, f: }, true]\n", {"a": "  x\n y", "b": "z\n\n", "c": [1, "b c", {"d": "e", "f": None}, True]}),
    ("- name: t # no\n  args:\n    p:\n      default: 0x1f\n  cmd: sh -c \"x: y\" #z\n- - 1\n  - -2.5\n", [{"name": "t", "args": {"p": {"default": 31}}, "cmd": 'sh -c "x: y"'}, [1, -2.5]]),
    ("a: one\n  two\n\n  three\nb: http://x.org:80/#y\n", {"a": "one two\nthree", "b": "http://x.org:80/#y"}),
    ("{a: [1,\n  2], b: 'c'}", {"a": [1, 2], "b": "c"}),
    ("a: 'x\n\n  y'\nyes: no\n", {"a": "x\ny", True: False}),
    ("a: |\n\n  x\nb: ''\n", {"a": "\nx\n", "b": ""}),
    ("", None),
    ("just text", "just text"),
]
BAD = ["a: 1\n---\nb: 2\n", "a: &x 1\n", "a:\n\tb: 1\n", "a: 'open\n", "a: [1, 2\n", "a: 1\n  b: 2\n", "- a\nb: 1\n", "a: 'x' y\n"]


@pytest.mark.parametrize("text, want", GOOD)
def test_yaml(text, want):
    assert yamlish.load(text) == want


@pytest.mark.parametrize("text", BAD)
def test_broken_yaml(text):
    with pytest.raises(yamlish.YamlError):
        yamlish.load(text)


def test_technique_files(spark):
    good = "attack_technique: T1\natomic_tests:\n- name: n\n  supported_platforms: [Linux, macOS]\n  input_arguments:\n    p: {default: 80}\n    q: {type: x}\n  executor:\n    name: sh\n    command: |\n      nc #{p}\n      ls\n- name: other\n  executor: {name: powershell, command: x}\n"
    files = spark.createDataFrame([("a", good), ("b", "a: [1"), ("c", "- x"), ("d", None), ("e", "atomic_tests: 5")], "path string, content string")
    rows = {r["path"]: r for r in parsers.technique_commands(files).collect()}
    assert rows["a"].asDict() == {"path": "a", "technique": "T1", "name": "n", "platforms": ["linux", "macos"], "command": "nc #{p}\nls\n", "arguments": {"p": "80"}, "error": None}
    assert set(rows) == {"a", "b", "e"} and rows["b"]["error"] and rows["e"]["error"]


def test_front_matter(spark):
    page = "---\nfunctions:\n  shell:\n  - code: |\n      x\n    contexts:\n      sudo:\n        code: y\n  send: {receiver: tcp, code: z}\ncode: outside\n"
    files = spark.createDataFrame([("a", page + "...\n"), ("b", page + "---\n"), ("c", "---\nfunctions: text\n"), ("d", "broken: [")], "path string, content string")
    got = [(r["path"], r["pos"], r["command"]) for r in parsers.front_matter_codes(files).orderBy("path", "pos").collect()]
    assert got == [(p, k, c) for p in "ab" for k, c in enumerate(["x\n", "y", "z"])] + [("c", -1, None), ("d", -1, None)]


def test_book(spark):
    text = "# A\n## B ##\n```bash\n# no heading\nx\n````\n# C\n~~~ {sh} y\n~~~\n### D\n``` ps1\ngone\n```\n```console\nlast"
    assert list(parsers.sections(text)) == [(["A", "B"], "bash", ["# no heading", "x"]), (["C"], "{sh}", []), (["C", "D"], "ps1", ["gone"]), (["C", "D"], "console", ["last"])]
    pages = spark.createDataFrame([("linux-hardening/a.md", text), ("./linux-hardening/windows/a.md", text), ("linux-hardening/PowerShell-b.md", text), ("crypto/a.md", text), (None, text), ("linux-hardening/n.md", None)], "path string, text string")
    lines, counts = parsers.walked(pages)
    assert [(r["headings"], r["line"]) for r in lines.orderBy("block", "pos").collect()] == [(["A", "B"], "# no heading"), (["A", "B"], "x"), (["C", "D"], "last")]
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"page_walked": 2, "page_windows": 2, "page_offtopic": 2, "fence_shell": 2, "fence_windows": 1}


def test_session_pool(spark):
    harmless, other = ["Harmless"], ["Harmless", "Discovery"]
    rows = [(1, "ls -la; wget x", harmless), (2, "ls -la", harmless), (3, "wget x && uname", other), (4, None, harmless), (5, "echo 'open; id -a", None), (6, "pwd", harmless)]
    pool, report = readers.session_pool(spark.createDataFrame(rows, "id long, full_session string, Set_Fingerprint array<string>"), ["id"])
    assert sorted(r["command"] for r in pool.collect()) == ["uname", "wget x"]
    assert report.first().asDict() == {"sessions": 6, "distinct_atoms": 5, "well_formed_dropped": 1, "after_well_formed": 4, "harmless_only_dropped": 2, "after_harmless_drop": 2, "marker_probe_pool_coverage": 1}


def test_required_names_the_missing_file(spark, tmp_path):
    (tmp_path / "a.cm").write_text("ls\n")
    assert readers.required(spark, f"{tmp_path}/a.cm", f"{tmp_path}/*.cm") == [f"{tmp_path}/a.cm", f"{tmp_path}/*.cm"]
    with pytest.raises(FileNotFoundError, match="b.cm"):
        readers.required(spark, f"{tmp_path}/a.cm", f"{tmp_path}/b.cm")


def test_broken_builds_fail_in_the_write(spark, tmp_path):
    good = spark.createDataFrame([("a", 1, 1, "x"), ("b", 0, 1, "y"), ("c", 0, 2, "x")], "command string, label int, dataset int, shape string")
    P.checked(good).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3
    for row, what in ((("a", 1, 2, "z"), "both datasets: a"), (("e", 0, 1, "x"), "two labels: x")):
        bad = good.union(spark.createDataFrame([row], good.schema))
        with pytest.raises(Exception, match=what):
            P.checked(bad).write.parquet(str(tmp_path / what.split(":")[0]))
    twice = spark.createDataFrame([("a", "s", 1, 1, "x"), ("b", "s", 0, 1, "y"), ("b", "s", 0, 1, "y")], "command string, source string, label int, dataset int, shape string")
    with pytest.raises(Exception, match="chosen twice"):
        P.balanced(twice).collect()


CARD = """# Corpus

## Rows per source

| source | n | share |
| --- | ---: | ---: |
| a | 3 | 0.7500 |
| b | 1 | n/a |

## Drops

None.
"""


def test_stats_document_and_card(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, None), ("a", 3, 0.75)], "source string, n long, share double")
    document = sinks.stats_document({"sources": rows, "drops": rows.limit(0)})
    sinks.write_document(document, str(tmp_path / "stats"))
    back = sinks.read_document(spark, str(tmp_path / "stats"), document.schema)
    assert sinks.same_document(document, back) and not sinks.same_document(document, sinks.stats_document({"sources": rows.limit(1), "drops": rows}))
    assert sinks.card("Corpus", back, {"sources": "Rows per source", "drops": "Drops"}) == CARD
    sinks.write_document(document.union(document), str(tmp_path / "two"))
    with pytest.raises(ValueError):
        sinks.read_document(spark, str(tmp_path / "two"), document.schema)


def test_qualified_paths(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == qualified(spark, f"file:{tmp_path}")
