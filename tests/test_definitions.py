import pytest
import regex as rx

from conftest import rows
from lineweave import spec, streaming, testing
from lineweave.library import LibraryError, load, resolve
from lineweave.operators import crossfile, discovery, mapping, syntax
from lineweave.sources import lines as src
from lineweave.sources import sinks

TOML = """
name = "t"
[aliases]
num = '\\d+'
[[filter]]
drop = ["DEBUG", "TRACE"]
[[substitute]]
pattern = "${num}"
replacement = "N"
ignore_case = true
[[test]]
name = "first only"
input = "a 1 2"
expected = "a N 2"
expected_matches = 1
[[test]]
name = "dropped"
input = "DEBUG"
expected = ""
[[test]]
name = "wrong"
input = "a"
expected = "b"
[[test]]
name = "later"
input = "a"
skip = true
"""


def test_loading(tmp_path):
    p = spec.loads(TOML)
    assert [s.type for s in p.steps] == ["filter", "substitute"]
    assert p.steps[0].pattern == "(?:DEBUG)|(?:TRACE)" and p.steps[0].action == "drop_line"
    assert p.steps[1].pattern == r"\d+" and not p.steps[1].is_global
    assert spec.from_dict(spec.to_dict(p)).steps == p.steps
    (tmp_path / "base.toml").write_text('[settings]\ncontext_before = 2\n[[filter]]\nkeep = "a"\n')
    (tmp_path / "child.toml").write_text('extends = "base.toml"\n[[filter]]\ndrop = "b"\n')
    child = spec.load(str(tmp_path / "child.toml"))
    assert child.settings.context_before == 2 and [s.pattern for s in child.steps] == ["a", "b"]
    (tmp_path / "base.toml").write_text('extends = "child.toml"\n')
    with pytest.raises(spec.SpecError):
        spec.load(str(tmp_path / "child.toml"))


def test_checks():
    assert spec.problems(spec.Pipeline()) == ["no steps"]
    bad = spec.from_dict({"step": [{"type": "substitute", "pattern": "a"}, {"type": "filter", "pattern": "x", "action": "keep_line"}, {"type": "filter", "pattern": "x", "action": "drop_line"}]})
    assert len(spec.problems(bad)) == 2
    assert spec.risky("(a+)+$") and not spec.risky("a+") and spec.complexity("a") < spec.complexity("((a|b)+.*.*)+")
    assert any("names a group" in x for x in spec.lint(spec.from_dict({"step": [{"type": "substitute", "pattern": "(a)b*c", "replacement": "$1XX"}]})))
    assert spec.diff(spec.preset("git"), spec.preset("npm"))


def test_library(tmp_path):
    (tmp_path / "a.toml").write_text('patterns_include = ["b"]\n[patterns.x]\none = "1"\n')
    (tmp_path / "b.toml").write_text('[patterns.x]\none = "no"\ntwo = "2"\n')
    lib = load(str(tmp_path / "a.toml"))
    assert lib == {"x.one": "1", "x.two": "2"}
    assert resolve("${x.one}-${builtin:ssn}-${seq}", lib) == r"1-\b\d{3}-\d{2}-\d{4}\b-${seq}"
    with pytest.raises(LibraryError):
        resolve("${nope}", lib)
    (tmp_path / "b.toml").write_text('patterns_include = ["a"]\n')
    with pytest.raises(LibraryError):
        load(str(tmp_path / "a.toml"))


def test_embedded_tests(spark):
    found = testing.run_tests(spark, spec.loads(TOML))
    assert [(o.name, o.passed, o.skipped) for o in found] == [("first only", True, False), ("dropped", True, False), ("wrong", False, False), ("later", True, True)]
    assert testing.tap(found).startswith("TAP version 14\n1..4\nok 1") and 'failures="1"' in testing.junit(found) and "2 of 3 passed" in testing.text_report(found)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n\nlast")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("x\n")
    assert [r[2] for r in rows(src.read_lines(spark, str(tmp_path / "a.txt")), "line_no")] == ["one", "two", "", "last"]
    assert [r[3] for r in rows(src.read_lines(spark, str(tmp_path / "a.txt"), keep_ends=True), "line_no")] == ["CRLF", "LF", "LF", "NONE"]
    assert src.text_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.bin")]).count() == 1
    files, errors = src.discover([str(tmp_path), str(tmp_path / "none")], include=["*.txt"])
    assert [f[-5:] for f in files] == ["a.txt", "c.txt"] and len(errors) == 1
    state = spark.createDataFrame([(f"file:{tmp_path}/a.txt", 5, 1)], "source string, byte_offset long, line_number long")
    got = src.read_from_offsets(spark, [str(tmp_path / "a.txt")], state)
    assert [(r[1], r[2]) for r in rows(got, "line_no")] == [(2, "two"), (3, ""), (4, "last")]
    assert src.hunks("+++ b/x.py\n@@ -1,2 +3,4 @@\n@@ -9 +10,0 @@\n") == [("x.py", 3, 6)]
    sinks.edit_in_place(spark.createDataFrame([(str(tmp_path / "a.txt"), "new\n")], "source string, text string"), ".bak").collect()
    assert (tmp_path / "a.txt").read_text() == "new\n" and (tmp_path / "a.txt.bak").exists()
    with pytest.raises(OSError):
        sinks.commit_all({str(tmp_path / "a.txt"): "other", str(tmp_path / "no" / "dir"): "x"})
    assert (tmp_path / "a.txt").read_text() == "new\n"
    d = sinks.unified_diff(spark.createDataFrame([("f", "a\n")], "source string, text string"), spark.createDataFrame([("f", "b\n")], "source string, text string")).first()
    assert "-a\n+b\n" in d["diff"]


def test_cross_file(spark):
    df = spark.createDataFrame([("src/a.py", 1, "def foo():"), ("doc/a.md", 1, "nothing"), ("doc/b.md", 1, "about foo"), ("src/a.py", 2, "def bar():")], "source string, line_no long, value string")
    rules = [crossfile.Rule("docs", r"def (\w+)", "src/*", "doc/*", "foo"), crossfile.Rule("own", r"def bar", "src/*", "doc/*", "foo", related_path_template="doc/{stem}.md"), crossfile.Rule("off", "x", enabled=False)]
    assert rows(crossfile.check(df, rules), "rule") == [("docs", "doc/a.md", 2, "src/a.py", 1), ("own", "doc/a.md", 1, "src/a.py", 2)]
    assert [tuple(r) for r in crossfile.fixes(df, rules).collect()] == [("doc/a.md", "def foo\ndef bar")]
    assert crossfile.check(df.limit(0), rules).count() == 0
    atomic = [crossfile.Rule("docs", r"def (\w+)", "src/*", "doc/*", "foo", atomic=True)]
    assert sorted(r.source for r in crossfile.groups(crossfile.triggers(df, atomic), df, atomic).collect()) == ["doc/a.md", "doc/b.md", "src/a.py"]
    # A file that triggers its own rule doesn't count against itself.
    own = spark.createDataFrame([("x", 1, "t"), ("y", 1, "t"), ("z", 1, "t e")], "source string, line_no long, value string")
    assert rows(crossfile.check(own, [crossfile.Rule("r", "t", ensure_pattern="e")]), "related_source") == [("r", "x", 2, "y", 1), ("r", "y", 2, "x", 1)]


def test_mapping(spark):
    e = spark.createDataFrame([("a", "x", 0, 1), ("a", "y", 0, 2), ("b", "y", 0, 1)], "original string, transformed string, step_index int, created_at long")
    v = spark.createDataFrame([("a",), ("z",)], "value string")
    assert rows(mapping.apply(v, e), "value") == [("a", "y"), ("z", "z")]
    assert rows(mapping.apply(v, e, strict=True), "value") == [("a", "y"), ("z", None)]
    assert [tuple(r) for r in mapping.ambiguous(e).collect()] == [("y", 2)]
    p = spec.from_dict({"step": [{"type": "substitute", "pattern": "a\\.b", "replacement": "X"}, {"type": "transform", "pattern": "q+", "transform": "reverse"}]})
    assert [s.type for s in mapping.reversed_pipeline(p).steps] == ["transform", "substitute"]
    with pytest.raises(spec.SpecError):
        mapping.reversed_pipeline(spec.preset("git"))


def test_learning():
    best = discovery.learn(["AB-12", "CD-34", "EF-56"], ["AB12"])
    assert best and all(b["confidence"] >= 70 for b in best)
    import regex as rx

    assert all(rx.fullmatch(r"[a-c]{2}-\d{3}x?", discovery.sample(r"[a-c]{2}-\d{3}x?", seed)) for seed in range(20))


@pytest.mark.parametrize(
    ("language", "text", "scope", "expected"),
    [
        ("python", "foo = 'foo'  # foo\ndef test_foo():\n    foo()\n", ["strings"], 1), ("python", "foo = 'foo'  # foo\ndef test_foo():\n    foo()\n", ["code"], 3), ("python", "foo = 'foo'  # foo\ndef test_foo():\n    foo()\n", ["tests"], 2),
        ("javascript", 'const foo = "foo"; // foo\nfunction foo() { foo }', ["functions"], 2), ("rust", 'fn foo() { let x = "foo}"; foo }', ["functions"], 3), ("go", "/* foo */ foo", ["comments"], 1), ("json", '{"foo": "foo"}', ["keys"], 1), ("yaml", "foo: foo # foo", ["values"], 1),
    ],
)
def test_scopes(language, text, scope, expected):
    from lineweave.functions.regex import Pattern

    assert len(syntax.in_scope(text, Pattern("foo"), syntax.ranges(text, language, scope))) == expected


def test_scoped_operators(spark):
    df = spark.createDataFrame([("f", "foo = 'foo'\nbar"), ("g", None)], "source string, text string")
    assert [r.result for r in syntax.scoped(df, "replace", "foo", "python", ["strings"], replacement="x").orderBy("source").collect()] == ["foo = 'x'\nbar", None]
    assert syntax.scoped(df, "keep", "foo", "python", ["strings"]).orderBy("source").first().result == "foo = 'foo'"
    with pytest.raises(ValueError, match="no scopes"):
        syntax.scoped(df, "keep", "foo", "cobol", [])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("keep 1\nskip\n")
    p = spec.from_dict({"step": [{"type": "filter", "pattern": "keep", "action": "keep_line"}, {"type": "substitute", "pattern": r"\d", "replacement": "N"}]})
    got = []
    q = streaming.start(p, streaming.watch(spark, str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted((r.value, r.out) for r in got) == [("keep 1", "keep N"), ("skip", None)]
    (tmp_path / "in" / "b.txt").write_text("keep 2\n")
    q = streaming.start(p, streaming.watch(spark, str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert len(got) == 3
    with pytest.raises(spec.SpecError):
        streaming.line_by_line(spec.from_dict({"step": [{"type": "block", "pattern": "a"}]}), spark.createDataFrame([("a",)], "value string"))


def test_scoped_steps_in_a_pipeline(spark):
    from lineweave import engine

    df = spark.createDataFrame([("a.py", 1, "foo = 'foo'  # foo"), ("a.py", 2, "foo"), ("b.txt", 1, "foo")], "source string, line_no long, value string")
    p = spec.from_dict({"step": [{"type": "substitute", "pattern": "foo", "replacement": "x", "language": "python", "scope": ["strings", "comments"]}, {"type": "filter", "pattern": "x|foo", "action": "keep_line"}]})
    assert [r[2] for r in rows(engine.run(p, df).lines, "source", "line_no")] == ["foo = 'x'  # x", "foo", "foo"]


def test_exit_codes(spark, tmp_path, capsys):
    from lineweave.__main__ import CONFIG, INVALID, IO, NO_MATCH, OK, USAGE, main

    f = tmp_path / "a.txt"
    f.write_text("one 1\ntwo\n")
    assert main(["-p", r"\d", str(f)]) == OK and capsys.readouterr().out == "one 1\n"
    assert main(["-p", "zzz", str(f)]) == NO_MATCH
    assert main(["-p", r"\d", "-r", "N", "--line-numbers", str(f)]) == OK and capsys.readouterr().out == "1: one N\n2: two\n"
    assert main([]) == USAGE and main(["-c", str(tmp_path / "none.toml")]) == IO and main(["-p", "a", str(tmp_path / "none")]) == IO
    (tmp_path / "bad.toml").write_text("[[step]]\ntype = 'substitute'\npattern = 'a'\n")
    assert main(["-c", str(tmp_path / "bad.toml"), str(f)]) == INVALID
    (tmp_path / "broken.toml").write_text("[[")
    assert main(["-c", str(tmp_path / "broken.toml")]) == CONFIG
    assert crossfile.outcome(2, "fail") == (False, "2 files lack what a rule asks for") and crossfile.outcome(2, "skip")[0]


def test_toml_round_trip():
    p = spec.from_dict({"name": "n", "settings": {"fixed_strings": True}, "aliases": {"x": "y"}, "step": [{"type": "substitute", "pattern": 'a"\\d\n', "replacement": "$1 ü"}, {"type": "block", "start_pattern": "^s", "action": {"mark_block": {"marker": "> "}}}, {"type": "transform", "pattern": ".*", "transform": {"type": "plugin", "name": "repeat", "args": [2]}}]})
    again = spec.loads(spec.to_toml(p))
    assert spec.to_dict(again) == spec.to_dict(p)


def test_settings_that_forbid():
    step = {"type": "filter", "pattern": "(a+)+$", "action": "keep_line"}
    assert spec.problems(spec.from_dict({"settings": {"strict_mode": True, "pcre_mode": True}, "step": [step]}))
    assert not spec.problems(spec.from_dict({"settings": {"strict_mode": True}, "step": [step]}))
    assert spec.problems(spec.from_dict({"step": [{"type": "transform", "pattern": ".", "transform": {"type": "plugin", "name": "no such"}}]}))
    assert spec.problems(spec.from_dict({"settings": {"max_line_length": 5, "mode": "slurp"}, "step": [step]}))


def test_fixed_patterns_and_presets():
    from lineweave.library import BUILTIN

    hits = {"email": "a@b.co", "ipv4": "10.0.0.1", "ipv6": "1:2:3:4:5:6:7:8", "phone_us": "212-555-0130", "ssn": "912-34-5678", "date_iso": "2024-01-02", "date_us": "1/2/2024", "time_24h": "9:05", "datetime_iso": "2024-01-02 03:04:05", "uuid": "0" * 8 + "-0000-0000-0000-" + "0" * 12,
            "hex_id": "deadbeef", "url": "https://x.example/a", "credit_card": "1234 5678 1234 5678", "api_key": "abc-def_ghi-jkl_mno-p", "base64": "QUJDREVGR0hJSktMTU5PUA==", "log_level": "ERROR", "timestamp_syslog": "Jan  2 03:04:05", "json_object": "{a}", "semver": "1.2.3-rc.1"}
    assert set(hits) == set(BUILTIN) and len(BUILTIN) == 19
    for name, text in hits.items():
        assert rx.fullmatch(BUILTIN[name] + r"=*", text), name
    assert spec.preset("rust") == spec.preset("cargo") and len(spec.PRESETS) == 7
    with pytest.raises(spec.SpecError):
        spec.preset("none")


def test_scopes_of_calls_types_and_flow():
    text = "fn go(n: u32) -> Option<Item> { if n > 0 { println!(\"if x()\"); return make(n); } None } // call()"
    pick = lambda scope: [text[a:b] for a, b in syntax.ranges(text, "rust", [scope])]
    assert pick("function_calls") == ["make"] and pick("macros") == ["println!"] and pick("control_flow") == ["if", "return"]
    assert pick("types") == ["u32", "Option<Item>"] and "n" in pick("identifiers") and "call" not in pick("identifiers")
    code = "def f(a: int) -> str:\n    if a:\n        return g(a)\n"
    pick = lambda scope: [code[a:b] for a, b in syntax.ranges(code, "python", [scope])]
    assert pick("function_calls") == ["g(a)"] and pick("types") == ["int", "str"] and pick("control_flow")[0].startswith("if a")


def test_plugins_from_a_folder_and_shell_warnings(tmp_path):
    from lineweave.functions import transforms as tf

    (tmp_path / "shout.sh").write_text("tr a-z A-Z\n")
    assert tf.load_plugins(str(tmp_path)) == ["shout"] and tf.load_plugins(str(tmp_path / "none")) == []
    assert tf.action({"type": "plugin", "name": "shout"})("abc") == "ABC"
    del tf.REGISTRY["shout"]
    assert [w.split(":")[0] for w in tf.shell_warnings("curl x | sudo rm y > z")] == ["rm", "curl", "sudo", ">"] and tf.shell_warnings("sort") == []


def test_related_paths_as_expressions(spark):
    from pyspark.sql import functions as F

    paths = ["a/b/c.rs", "x.py", "/r/.hidden", "d/no", "e/f.tar.gz", "g/..x.y"]
    for template in ("{dir}/tests/{stem}_test.{ext}", "docs/{name}.md", "{stem}"):
        df = spark.createDataFrame([(p,) for p in paths], "s string").select("s", crossfile._related(template, F.col("s")).alias("r"))
        assert {r.s: r.r for r in df.collect()} == {p: crossfile.related_path(template, p) for p in paths}


def test_examples_by_sign():
    assert discovery.examples("+ AB-1\n# note\n- AB1\nCD-2\n\n") == (["AB-1", "CD-2"], ["AB1"])
    with pytest.raises(ValueError):
        discovery.learn(["x"] * (discovery.MOST_EXAMPLES + 1))
