import random

import pytest
import regex as rx

from conftest import rows
from lineweave import engine, spec
from lineweave.functions.fpe import Ff1
from lineweave.functions.regex import Pattern, UnsupportedPattern, java_template, substitute, template
from lineweave.functions.transforms import REGISTRY, mask_deterministic, url_decode, url_encode
from lineweave.operators import ordered


def frame(spark, text, source=1):
    return spark.createDataFrame([(source, n, v) for n, v in enumerate(text.split("\n"), 1)], "source int, line_no long, value string")


def out(spark, text, *steps, **settings):
    p = spec.from_dict({"step": list(steps), "settings": settings})
    return [r[2] for r in rows(engine.run(p, frame(spark, text)).lines, "line_no")]


def test_extract_deduplicate_with_stats_and_trace(spark):
    p = spec.from_dict({"step": [{"type": "extract", "pattern": r"\[\w+\]", "deduplicate": True}, {"type": "substitute", "pattern": "R", "replacement": "r"}]})
    want = rows(engine.run(p, frame(spark, LOG)).lines, "line_no")
    r = engine.run(p, frame(spark, LOG), stats=True)
    assert [x[2] for x in want] == ["[INFO]", "[ErrOr]", "[DEBUG]"]
    assert rows(r.lines, "line_no") == want == rows(engine.run(p, frame(spark, LOG), trace=True).lines, "line_no")
    s = {x.step_index: x for x in r.stats.collect()}
    assert s[0].lines_out == 3 and s[1].lines_in == 3


LOG = "2024 [INFO] start user_id=7\n2024 [ERROR] bad 192.168.1.2\n2024 [DEBUG] noise\n2024 [ERROR] bad again"


@pytest.mark.parametrize(
    ("steps", "settings", "expected"),
    [
        ([{"type": "substitute", "pattern": r"\[ERROR\]", "replacement": "[ERR]"}, {"drop": "DEBUG", "type": "filter"}, {"type": "substitute", "pattern": r"user_id=(\d+)", "replacement": "uid=${1}"}], {}, ["2024 [INFO] start uid=7", "2024 [ERR] bad 192.168.1.2", "2024 [ERR] bad again"]),
        ([{"type": "filter", "pattern": "bad", "action": "keep_line", "not_pattern": "again"}], {}, ["2024 [ERROR] bad 192.168.1.2"]),
        ([{"type": "filter", "pattern": "bad", "action": "keep_line"}], {"invert_match": True}, ["2024 [INFO] start user_id=7", "2024 [DEBUG] noise"]),
        ([{"type": "filter", "pattern": r"\[(\w+)\]", "action": "deduplicate_by_prefix"}], {}, LOG.split("\n")[:3]),
        ([{"type": "extract", "pattern": r"\d+"}], {}, ["2024\t7", "2024\t192\t168\t1\t2", "2024", "2024"]),
        ([{"type": "extract", "pattern": r"(\w+)=(\d+)", "output_format": "json", "capture_names": ["k", "v"]}], {}, ['[{"k":"user_id","v":"7"}]']),
        ([{"type": "extract", "pattern": r"(\w+)=(\d+)", "output_format": "csv", "capture_names": ["k", "v"]}], {}, ["k,v\nuser_id,7"]),
        ([{"type": "extract", "pattern": r"\[\w+\]", "deduplicate": True}], {}, ["[INFO]", "[ERROR]", "[DEBUG]"]),
        ([{"type": "validate", "pattern": "bad", "on_mismatch": "skip"}], {}, [LOG.split("\n")[1], LOG.split("\n")[3]]),
        ([{"type": "transform", "pattern": r"\[\w+\]", "transform": "lowercase"}, {"type": "filter", "pattern": "error", "action": "keep_line"}], {}, ["2024 [error] bad 192.168.1.2", "2024 [error] bad again"]),
        ([{"type": "substitute", "pattern": "bad", "replacement": "b${seq}"}, {"keep": r"b\d", "type": "filter"}], {}, ["2024 [ERROR] b1 192.168.1.2", "2024 [ERROR] b2 again"]),
        ([{"type": "filter", "pattern": "noise", "action": "keep_line"}], {"context_before": 1}, ["2024 [ERROR] bad 192.168.1.2", "2024 [DEBUG] noise"]),
        ([{"type": "substitute", "pattern": "\n2024 ", "replacement": "; "}], {"mode": "slurp"}, [LOG.replace("\n2024 ", "; ")]),
        ([{"type": "substitute", "pattern": ".", "replacement": "$x"}], {"fixed_strings": True}, [x.replace(".", "$x") for x in LOG.split("\n")]),
        ([{"type": "filter", "pattern": "2024", "action": "keep_line"}], {"sample_limit": 2}, LOG.split("\n")[:2]),
    ],
)
def test_steps(spark, steps, settings, expected):
    assert out(spark, LOG, *steps, **settings) == expected


def test_stats_errors_and_tracing(spark):
    p = spec.from_dict({"step": [{"type": "filter", "pattern": "bad", "action": "keep_line"}, {"type": "validate", "pattern": "again"}, {"type": "substitute", "pattern": r"\d", "replacement": "N"}]})
    r = engine.run(p, frame(spark, LOG), stats=True)
    assert rows(r.stats, "step_index") == [(0, 4, 2, 2, 2, 0), (1, 2, 1, 1, 1, 0), (2, 1, 1, 0, 4, 1)]
    assert [(x.line_no, x.step_index) for x in r.errors.collect()] == [(2, 1)]
    assert [(x.line_no, x.dropped_by) for x in engine.why_dropped(p, frame(spark, LOG)).orderBy("line_no").collect()] == [(1, 0), (2, 1), (3, 0)]
    assert [x.step_index for x in engine.unused_steps(r.stats).collect()] == []


BLOCKS = "a\n<b\nx\n>\nc\n<b\ny\n>\n<b\nx\n>\n<b\nlost"


@pytest.mark.parametrize(
    ("action", "pattern", "expected"),
    [
        ("keep_block", "", "<b x > <b y > <b x > <b lost"), ("drop_block", "", "a c"), ({"mark_block": {"marker": "|"}}, "", "a |<b |x |> c |<b |y |> |<b |x |> |<b |lost"),
        ("keep_block", "y", "<b y >"), ("drop_block", "y", "a <b x > c <b x >"), ("deduplicate", "", "a <b x > c <b y > <b lost"), ({"substitute_in_block": {"pattern": "[bx]", "replacement": "_"}}, "", "a <_ _ > c <_ y > <_ _ > <_ lost"),
    ],
)
def test_blocks(spark, action, pattern, expected):
    assert out(spark, BLOCKS, {"type": "block", "start_pattern": "^<", "end_pattern": "^>", "pattern": pattern, "action": action}) == expected.split(" ")


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_automaton_and_context_against_a_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    draw = random.Random(4)
    data = [(s, n, "".join(c for c in "se" if draw.random() < 0.3)) for s in (1, 2) for n in range(1, 120)]
    df = spark.createDataFrame(data, "source int, line_no long, value string")
    got = {(r.source, r.line_no): (r.in_block, r.block_id) for r in ordered.blocks(df, df["value"].contains("s"), df["value"].contains("e")).collect()}
    for s in (1, 2):
        inside, k = False, 0
        for _, n, v in [d for d in data if d[0] == s]:
            entering = not inside and "s" in v
            k += entering
            assert got[s, n] == (inside or "s" in v, k)
            if inside and "e" in v or entering and "e" in v:
                inside = entering and not ("e" in v and entering) if entering else False
                inside = False if not entering else "e" not in v or True
            elif entering:
                inside = True
    near = {(r.source, r.line_no) for r in ordered.context(df, df["value"] == "se", 2, 1).collect()}
    assert near == {(s, n) for s, n, _ in data if any(x == s and v == "se" and -2 <= n - m <= 1 for x, m, v in data)}
    sums = {(r.source, r.line_no): r.k for r in ordered.prefix_sum(df, df["line_no"], "k").collect()}
    assert all(v == n * (n + 1) // 2 for (_, n), v in sums.items())


def test_regex_dialect(spark):
    cases = [(r"^\w+$", "größe", True), (r"ab$", "ab\n", False), (r"a.b", "a\rb", True), (r"(?P<x_1>a)b", "ab", True), (r"[[:punct:]]", "!", True), (r"É", "é", True)]
    for p, text, hit in cases:
        pat = Pattern(p, frozenset({"case_insensitive"}) if p == "É" else frozenset())
        df = spark.createDataFrame([(text,)], "v string")
        assert df.filter(df["v"].rlike(pat.java)).count() == hit, p
        assert bool(pat.python.search(text)) == hit, p
    with pytest.raises(UnsupportedPattern):
        Pattern("(?U)a*").java
    with pytest.raises(UnsupportedPattern):
        Pattern("[a-z--b]").java


@pytest.mark.parametrize(("t", "expected"), [("${1}7", "a7"), ("$1x", ""), ("$2", ""), ("$$1", "$1"), ("\\", "\\"), ("[$0]", "[ab]"), ("${n}", "b"), ("$", "$")])
def test_templates(spark, t, expected):
    p = Pattern("(a)(?P<n>b)") if "n" in t else Pattern("(a)b")
    assert substitute(p, "ab", lambda m: "".join(x if isinstance(x, str) else m[x] or "" for x in template(t, p)))[0] == expected
    df = spark.createDataFrame([("ab",)], "v string")
    from pyspark.sql import functions as F

    assert df.select(F.regexp_replace("v", p.java, java_template(template(t, p)))).first()[0] == expected


@pytest.mark.parametrize(
    ("pattern", "required"),
    [(r"(\w+)@(\w+)", "@"), (r"ab*c", "a"), (r"ab+c", "ab"), (r"ab|cd", ""), (r"(ab|cd)ef", "ef"), (r"\[ERROR\] x", "[ERROR] x"), (r"(?i)abc", ""), (r"a{0,2}bc", "bc"), (r"[]x]yz\d", "yz"), (r"(?!no)yes", "yes"), (r"\p{Lu}q", "q"), (r"(a(b[)]c)d)?e", "e"), (r"\d+", ""), (r"ab?", "a"), (r"\x41bc", ""), (r"(a)\1b", ""), (r"a\bcd", "cd")],
)
def test_required(pattern, required):
    assert Pattern(pattern).required == required
    assert Pattern(pattern, frozenset({"case_insensitive"})).required == ""


def test_empty_matches():
    assert substitute(Pattern(r"\d*"), "12a", lambda m: "-") == ("-a-", 2)


def test_functions():
    assert Ff1(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), b"", 10).encrypt("0123456789") == "2433477484"
    f = Ff1(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3cef4359d8d580aa4f7f036d6f04fc6a94"), bytes.fromhex("3737373770717273373737"), 36)
    assert f.encrypt("0123456789abcdefghi") == "xs8a0azh2avyalyzuwd" and f.decrypt("xs8a0azh2avyalyzuwd") == "0123456789abcdefghi"
    assert mask_deterministic("12345678", "k", keep_prefix=2, keep_suffix=2)[:2] == "12" and mask_deterministic("123", "k", keep_prefix=2, keep_suffix=1) == "123"
    assert mask_deterministic("abc", "k") == mask_deterministic("abc", "k") and mask_deterministic("abc", "k", "x") == "xxx"
    assert url_encode("a é") == "a%20%E9" and url_decode("a%20+%E9") == "a  é" and url_decode("%zz") == "%zz"
    call = lambda n, s, *a: REGISTRY[n](s, list(a))
    assert [call("snake_case", "aBc"), call("camel_case", "foo_bar baz"), call("pascal_case", "foo-bar"), call("pad_left", "7", "3", "0"), call("truncate", "abcdef", "3"), call("transpose", "Bbm", "2"), call("format_number", "1234567"), call("increment", "x"), call("hex_decode", "6869"), call("char_freq", "abba c")] == ["a_bc", "fooBarBaz", "FooBar", "007", "abc...", "Cm", "1,234,567", "x", "hi", "a:2,b:2, :1,c:1"]


def test_random_pipelines_against_a_loop(spark):
    draw = random.Random(2)
    text = "\n".join("".join(draw.choice("ab1 ") for _ in range(8)) for _ in range(60))
    for _ in range(6):
        steps = [draw.choice([("substitute", r"a+", "<$0>"), ("substitute", r"(\d)b", "b${1}"), ("keep", "a", None), ("drop", r"^ ", None), ("first", "b", "B")]) for _ in range(4)]
        want = text.split("\n")
        raw = []
        for kind, p, r in steps:
            if kind == "keep":
                want = [x for x in want if rx.search(p, x)]
                raw.append({"type": "filter", "pattern": p, "action": "keep_line"})
            elif kind == "drop":
                want = [x for x in want if not rx.search(p, x)]
                raw.append({"type": "filter", "pattern": p, "action": "drop_line"})
            else:
                want = [rx.sub(p, r.replace("$0", r"\g<0>").replace("${1}", r"\1"), x, count=int(kind == "first")) for x in want]
                raw.append({"type": "substitute", "pattern": p, "replacement": r, **({"flags": ["unicode"]} if kind == "first" else {})})
        assert out(spark, text, *raw) == want


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, ""), (None, 1, "a")], "source int, line_no long, value string")
    p = spec.from_dict({"step": [{"type": "substitute", "pattern": "a", "replacement": "b"}]})
    assert sorted(r.value for r in engine.run(p, df).lines.collect()) == ["", "b"]
    assert engine.run(p, df.limit(0)).lines.count() == 0


def test_scopes_over_whole_files(spark):
    from lineweave.operators import syntax

    lines = [("a.py", 1, 'x = """it\'s one', None), ("a.py", 2, "isn't two", None), ("a.py", 3, None, 'three"""; y = 4'), ("a.py", 1, 'x = """it\'s one', None), ("b.js", 1, "f('five'); six", None), ("c.log", 1, "'seven'", None), ("d.yml", 1, 'k: "eight"', None)]
    df = spark.createDataFrame(lines, "path string, line_number long, original_line string, transformed_line string")
    got = {r.source: r.result for r in syntax.scoped_files(df, "extract", r"\w{3,}", ["strings"]).collect()}
    assert got == {"a.py": ["one", "isn", "two", "three"], "b.js": ["five"], "d.yml": ["eight"]}
