import pytest

from conftest import rows
from lineweave.functions.headers import BRACE, MEMBER, NONE, OTHER_BRACE, START, HeaderParser
from lineweave.operators import log_entries
from lineweave.operators.log_entries import find_entries, find_instants


DDL = "line_id long, path string, line_number long, original_line string, transformed_line string, extra int"
PLAIN = [
    ('<35>1 2023-01-01T01:29:23.937982Z db-11 billing.worker 43669 ID56 [meta seq="1689"] replaced', "ERROR", "billing.worker"),
    ("<135>Jun  4 15:02:33 store-11 mapping.store[45956]: killed", "DEBUG", "mapping.store"),
    ("DEBUG:router:no route", "DEBUG", "router"),
    ("D com.x.Pool: checkpoint @ 2023-11-04T23:52:26-06:00", "DEBUG", "com.x.Pool"),
    ("I0904 00:10:30.647002   19091 parser.go:231] no route", "INFO", "parser"),
    ('ts="24.07.2023 21:06:34" level=crit component=ingest.parser pid=7 msg="level=debug"', "FATAL", "ingest.parser"),
    ('level=INFO msg="a \\"b\\" c" component=x time=1672531443695', "INFO", "x"),
    ('{"message":"m","component":"n","log.level":30,"@timestamp":"2024-02-05 23:34:43 UTC"}', "INFO", "n"),
    ('10.0.0.1 - a@b.example [01/Jan/2023:00:00:37 +0000] "GET / HTTP/1.1" 200 1 "-" "-"', "", ""),
]
#: Lines whose fields stand where their templates have them.
MINED = [
    ("2025-03-29 23:58:33,229 [TRACE] export.csv: retry", "TRACE", "export.csv"),
    ("[2023-01-01T01:38:02.542Z] sync-agent.INFO: package []", "INFO", "sync-agent"),
    ("20231029-050337 - queue.consumer - WARNING - compiled", "WARN", "queue.consumer"),
    ("May 12 22:04:20 edge-02 com.x.Pool[9959]: peer", "", "com.x.Pool"),
    ("1698538027.268 report.render SEVERE schema", "ERROR", "report.render"),
    ("2023-07-07 03:14:28|notice|ingest.reader|token", "INFO", "ingest.reader"),
    ("2023-01-01T10:02:59.525Z INFO  [pool-2-31] sync-agent - skipping", "INFO", "sync-agent"),
    ("2025-01-01T00:38:08+01:00 [\x1b[34minfo\x1b[0m] scheduler: replaced\r", "INFO", "scheduler"),
    ("2024-13-41 25:61:00 [W] a.b: impossible date", "WARN", "a.b"),
]


@pytest.mark.parametrize(("line", "level", "name"), PLAIN)
def test_headers(line, level, name):
    got = HeaderParser().parse(line)
    assert (got[0], got[1], got[2]) == (START, level, name)


def fields(spark, lines, **how):
    df = spark.createDataFrame([(n, "/f", n, x, None, 0) for n, x in enumerate(lines, 1)], DDL)
    headers = log_entries.parse_lines(log_entries.lines_of(df)).cache()
    templates = log_entries.mine_templates(headers, **how)
    return [(r.level, r.component) for r in log_entries.with_fields(headers, templates).filter(f"what = {START}").orderBy("line_number").collect()], templates


def test_templates_decide_fields(spark):
    lines = [line for line, _, _ in MINED * 3]
    got, templates = fields(spark, lines)
    assert got == [(level, name) for _, level, name in MINED * 3] and len(templates) >= 6
    # Without constants there are no templates; the fallback rules know only names with a colon.
    got, templates = fields(spark, lines, support=2.0)
    assert not templates and got != [(level, name) for _, level, name in MINED * 3] and ("WARN", "") in got


def test_text_with_a_level_word_is_no_template(spark):
    words = ["alpha", "bravo", "carol", "delta", "eager", "frost", "gamma", "hotel"]
    lines = [f"2025-03-29 23:58:{n:02} report.render WARN x" for n in range(20)] + [f"2025-03-29 23:59:{n:02} {a}{b} error text" for n, (a, b) in enumerate((a, b) for a in words for b in words)]
    got, _ = fields(spark, lines, support=0.05)
    assert got[:20] == [("WARN", "report.render")] * 20
    # The name slot of "name LEVEL" is a constant in 20 of 84 lines, so its lines are records; where it never is, they are text.
    got, _ = fields(spark, lines[20:], support=0.05)
    assert set(got) == {("", "")}


@pytest.mark.parametrize("line", ["", "   ", "\tat com.x.Y.run(Z.java:1)", "Caused by: x: peer closed at 2024-01-01 00:00", "SELECT id FROM jobs", "KeyError: slow query", "f99ce2c575e52a5bc00d48487839930a", "-- dump follows, WARN threshold 48 --"])
def test_no_headers(line):
    assert HeaderParser().parse(line)[0] == NONE


@pytest.mark.parametrize("address", ["::1", "::ffff:10.0.0.1", ":::1", "2001:db8::1", ".1"])
def test_access_lines_by_their_first_character(address):
    got = HeaderParser().parse(f'{address} - - [10/Oct/2025:13:55:36 +0000] "GET / HTTP/1.1" 200 5')
    assert got[0] == (START if len(address) > 2 else NONE) and bool(got[4]) == (len(address) > 2)
    assert HeaderParser().parse('"level": "info",')[0] == NONE


def test_braces():
    p = HeaderParser()
    assert [p.parse(x)[0] for x in ("{", '  "level": "info",', '  "other": 1', "payload {", "}")] == [BRACE, MEMBER, NONE, OTHER_BRACE, OTHER_BRACE]


FILES = "path string, language string, zone string, first_day string, line_number int"


def tables(spark, lines, files):
    return spark.createDataFrame(lines, DDL), spark.createDataFrame(files, FILES)


def case(spark):
    text = [
        "junk before the first entry", "2024-10-27 02:10:00 [INFO] a.b: one", "  continued", "2024-10-27 02:50:00 [WARN] a.b: two", "{", '  "level": "info",', '  "ts": "2024-10-27 02:05:00",', '  "logger": "c.d"', "}",
        "payload {", '  "level": "info"', "}", "2024-10-27 02:20:00 [INFO] a.b: later", "2024-10-27T03:30:00Z [INFO] a.b: end", "tail",
    ]
    lines = [(n, "/f", n, t, None, 0) for n, t in enumerate(text, 1)]
    lines[3] = (4, "/f", 4, None, text[3], 0)  # a lost original
    lines += [(100, "/f", 2, text[1], None, 0), (101, "/code", 1, "2024-01-01 00:00:00 [INFO] x.y: no log", None, 0), (102, None, 1, "x", None, 0), (103, "/f", None, "x", None, 0), (104, "/g", 1, "", None, 0), (105, "/g", 2, None, None, 0)]
    return tables(spark, lines, [("/f", "log", "Europe/Berlin", "2024-10-27", 1), ("/code", "python", None, None, 1), ("/g", "log", None, None, 1)])


@pytest.mark.parametrize("chunk", [50_000, 4, 1])
def test_entries_and_instants(spark, monkeypatch, chunk):
    monkeypatch.setattr(log_entries, "CHUNK", chunk)
    lines, files = case(spark)
    assert rows(find_entries(lines, files), "first_line") == [
        ("/f", 2, 3, "INFO", "a.b"), ("/f", 4, 4, "WARN", "a.b"), ("/f", 5, 12, "INFO", "c.d"), ("/f", 13, 13, "INFO", "a.b"), ("/f", 14, 15, "INFO", "a.b"),
    ]
    base = 1729987200_000_000  # 2024-10-27T00:00:00Z
    minute = 60_000_000
    assert rows(find_instants(lines, files), "line_id") == [(2, base + 10 * minute), (7, base + 65 * minute), (13, base + 80 * minute), (14, base + 210 * minute), (100, base + 10 * minute)]


def test_empty_tables(spark):
    lines, files = tables(spark, [], [])
    assert find_entries(lines, files).count() == 0
    assert find_instants(lines, files).count() == 0


@pytest.mark.parametrize("chunk", [50_000, 4])
def test_full_entries(spark, monkeypatch, chunk):
    monkeypatch.setattr(log_entries, "CHUNK", chunk)
    lines, files = case(spark)
    got = {r.first_line: (r.ts_us, r.message) for r in log_entries.full_entries(lines, files).collect()}
    assert got[2] == (1729987200_000_000 + 600_000_000, "one\n  continued")
    assert got[4][1] == "two" and got[14][1] == "end\ntail" and set(got) == {2, 4, 5, 13, 14}
    assert got[5][1] == '\npayload {\n  "level": "info"\n}'


@pytest.mark.parametrize(
    ("lines", "message"),
    [
        (["DEBUG router: lost \"x\" @ 2023-11-04T23:52:26-06:00"], 'lost "x"'), (["[1672531206] a.INFO: text []"], "text"), (['{"msg": "m \\"q\\"", "ts": 1672531206}'], 'm "q"'),
        (["{", '  "level": "info",', '  "msg": "inner"', "}", "more"], "inner\nmore"), (['level=INFO msg="a \\"b\\"" component=x time=1672531443695'], 'a "b"'), ([], ""),
    ],
)
def test_messages(lines, message):
    from lineweave.functions.headers import message_of

    assert message_of(lines) == message
