"""Registered queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine, spec, streaming
from .operators import crossfile, discovery, incremental, log_entries, mapping, syntax
from .plans import table as t
from .sources import sinks
from .sources.lines import split_lines, within_ranges

QUERIES: dict = {}
SQL: dict = {}

QUERIES["p1_found"] = lambda s, d: log_entries.find_entries(t(s, d, "line_matches"), t(s, d, "source_files"))
QUERIES["p3_found"] = lambda s, d: log_entries.find_instants(t(s, d, "line_matches"), t(s, d, "source_files"))

QUERIES["p4_found"] = lambda s, d: incremental.work_items(t(s, d, "source_files"), t(s, d, "checkpoints"), t(s, d, "pipeline_runs"), t(s, d, "mapping_entries")).drop("version")
SQL["p4_found"] = """
WITH last_states AS (
  SELECT path, arg_max(struct_pack(o := byte_offset, m := mtime, h := content_hash, i := inode), (last_processed, byte_offset, run_id)) AS s
  FROM checkpoints WHERE run_id IN (SELECT run_id FROM pipeline_runs WHERE status = 'succeeded') GROUP BY path),
files AS (
  SELECT file_id, CASE
    WHEN l.path IS NULL THEN 0 WHEN f.inode <> s.i THEN 0 WHEN f.size < s.o THEN 0 WHEN f.content_hash <> s.h THEN 0
    WHEN f.size > s.o THEN s.o WHEN (f.content_hash IS NULL OR s.h IS NULL) AND f.mtime > s.m THEN 0 END AS from_offset
  FROM source_files f LEFT JOIN last_states l ON f.path = l.path),
marks AS (SELECT pipeline_id, arg_max(read_until, (finished_at, run_id)) AS mark FROM pipeline_runs WHERE status = 'succeeded' GROUP BY 1),
m AS (SELECT e.*, mark, (mark IS NULL OR epoch_us(arrived_at) > mark * 1000000) AS after FROM mapping_entries e LEFT JOIN marks USING (pipeline_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, step_index, original ORDER BY created_at DESC, entry_id DESC) AS rn FROM m),
seen AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, step_index, original ORDER BY created_at DESC, entry_id DESC) AS rn FROM m WHERE NOT after)
SELECT 'file' AS kind, file_id AS record_id, from_offset::BIGINT AS from_offset FROM files WHERE from_offset IS NOT NULL
UNION ALL
SELECT 'mapping', r.entry_id, 0::BIGINT FROM ranked r
LEFT JOIN seen s ON s.rn = 1 AND s.pipeline_id = r.pipeline_id AND s.step_index = r.step_index AND s.original = r.original
WHERE r.rn = 1 AND r.after AND (s.entry_id IS NULL OR s.transformed IS DISTINCT FROM r.transformed)"""


# --- the pipeline language over the lines of documents -----------------------------------------------------------------

_LINES = """WITH pieces AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM pieces),
lines AS (SELECT doc_id AS source, unnest(range(1, len(a) + 1)) AS line_no, regexp_replace(unnest(a), '[\\r\\n]+$', '') AS value FROM cut)"""


def lines(s: SparkSession, d: str) -> DataFrame:
    return split_lines(t(s, d, "documents"), "doc_id", "text")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select(F.col("doc_id").alias("source"), "text")


def _pipeline(*steps: dict, **settings: object) -> spec.Pipeline:
    return spec.from_dict({"name": "query", "step": list(steps), "settings": settings})


def _add(name: str, p: spec.Pipeline, sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: engine.run(p, lines(s, d)).lines
    if sql:
        SQL[name] = _LINES + "\n" + sql


def _sub(pattern: str, replacement: str, **more: object) -> dict:
    return {"type": "substitute", "pattern": pattern, "replacement": replacement, **more}


def _fil(pattern: str, action: str = "keep_line", **more: object) -> dict:
    return {"type": "filter", "pattern": pattern, "action": action, **more}


_V = "SELECT source, line_no, value FROM lines WHERE "
QUERIES["scan_lines"] = lines
SQL["scan_lines"] = _LINES + " SELECT * FROM lines"
_add("multi_step_log", _pipeline(_sub(r"\[ERROR\]", "[ERR]"), _fil("DEBUG", "drop_line"), _sub(r"limit to (\d+)", "limit=${1}"), _sub(r"release (\d+)\.(\d+)", "release $2-$1")), r"""
SELECT source, line_no, regexp_replace(regexp_replace(regexp_replace(value, '\[ERROR\]', '[ERR]', 'g'), 'limit to ([0-9]+)', 'limit=\1', 'g'), 'release ([0-9]+)\.([0-9]+)', 'release \2-\1', 'g') AS value FROM lines WHERE NOT contains(value, 'DEBUG')""")
_add("filter_keep", _pipeline(_fil(r"version \d+\.\d+")), _V + r"regexp_matches(value, 'version [0-9]+\.[0-9]+')")
_add("filter_drop", _pipeline(_fil(r"^The ", "drop_line")), _V + "NOT regexp_matches(value, '^The ')")
_add("filter_keep_match", _pipeline(_fil(r"offset", "keep_match")), _V + "contains(value, 'offset')")
_add("filter_drop_match", _pipeline(_fil(r"offset", "drop_match")), _V + "NOT contains(value, 'offset')")
_add("filter_not_pattern", _pipeline(_fil("limit", not_pattern=r"offset|segment")), _V + "regexp_matches(value, 'limit') AND NOT regexp_matches(value, 'offset|segment')")
_add("filter_invert", _pipeline(_fil("limit"), invert_match=True), _V + "NOT regexp_matches(value, 'limit')")
_add("filter_alternation", spec.from_dict({"filter": [{"keep": ["limit", r"port \d+", "^#"]}]}), _V + "regexp_matches(value, '(?:limit)|(?:port [0-9]+)|(?:^#)')")
_add("filter_fixed", _pipeline(_fil("3.1"), fixed_strings=True), _V + "contains(value, '3.1')")
_add("filter_ignore_case", _pipeline(_fil("THE OFFSET", ignore_case=True)), _V + "regexp_matches(value, '(?i)the offset')")
_add("sample_limit", _pipeline(_fil("."), sample_limit=3), _V + "line_no <= 3 AND value <> ''")
_add("max_line_length", _pipeline(_sub("e", "E"), max_line_length=120), "SELECT source, line_no, CASE WHEN octet_length(encode(value)) + 1 > 120 THEN value ELSE replace(value, 'e', 'E') END AS value FROM lines")
_add("substitute_global", _pipeline(_sub(r"\d+", "N")), "SELECT source, line_no, regexp_replace(value, '[0-9]+', 'N', 'g') AS value FROM lines")
_add("substitute_groups", _pipeline(_sub(r"(\w+)-(\d+)\.", "${2}_$1.")), r"SELECT source, line_no, regexp_replace(value, '([\pL\pN_]+)-([0-9]+)\.', '\2_\1.', 'g') AS value FROM lines")
_add("substitute_named", _pipeline(_sub(r"line (?P<line_number>\d+)", "row ${line_number}")), r"SELECT source, line_no, regexp_replace(value, 'line ([0-9]+)', 'row \1', 'g') AS value FROM lines")
_add("substitute_first", _pipeline(_sub(r"(\d)(\d*)", "<$1>$2", flags=["case_insensitive"])), r"SELECT source, line_no, regexp_replace(value, '([0-9])([0-9]*)', '<\1>\2') AS value FROM lines")
_add("substitute_fixed", _pipeline(_sub("a.b", "$1"), _sub("the ", "THE "), fixed_strings=True), "SELECT source, line_no, replace(replace(value, 'a.b', '$1'), 'the ', 'THE ') AS value FROM lines")
_add("substitute_nullable", _pipeline(_sub(r"\d*", "-", flags=["global"])), "SELECT source, line_no, regexp_replace(value, '[0-9]*', '-', 'g') AS value FROM lines")
_add("substitute_disabled", _pipeline(_sub("e", "x", enabled=False), _fil("the")), _V + "contains(value, 'the')")
_add("strip_ansi", _pipeline(_fil("."), strip_ansi=True), r"SELECT source, line_no, regexp_replace(value, '\x1b\[[0-9;]*[A-Za-z]', '', 'g') AS value FROM lines WHERE regexp_replace(value, '\x1b\[[0-9;]*[A-Za-z]', '', 'g') <> ''")
_add("seq_numbers", _pipeline(_sub(r"offset", "offset#${seq}")))
_add("extract_text", _pipeline({"type": "extract", "pattern": r"\d+\.\d+\.\d+"}), r"SELECT source, line_no, array_to_string(regexp_extract_all(value, '[0-9]+\.[0-9]+\.[0-9]+'), chr(9)) AS value FROM lines WHERE regexp_matches(value, '[0-9]+\.[0-9]+\.[0-9]+')")
_add("extract_first", _pipeline({"type": "extract", "pattern": r"/\w+/\w+", "first_only": True}), "SELECT source, line_no, regexp_extract(value, '/[\\pL\\pN_]+/[\\pL\\pN_]+') AS value FROM lines WHERE regexp_matches(value, '/[\\pL\\pN_]+/[\\pL\\pN_]+')")
_add("extract_jsonl", _pipeline({"type": "extract", "pattern": r"(\w+) (\d+)", "output_format": "jsonl", "capture_names": ["word", "number"]}))
_add("extract_csv", _pipeline({"type": "extract", "pattern": r"(\w+) (\d+)", "output_format": "csv"}))
_add("extract_template", _pipeline({"type": "extract", "pattern": r"(\w+)=(\w+)", "output_template": "$2:$1"}))
_add("extract_dedup", _pipeline({"type": "extract", "pattern": r"[a-z]+\.[a-z]+\b", "first_only": True, "deduplicate": True}), r"""
, x AS (SELECT source, line_no, regexp_extract(value, '[a-z]+\.[a-z]+\b') AS value FROM lines WHERE regexp_matches(value, '[a-z]+\.[a-z]+\b'))
SELECT source, line_no, value FROM x QUALIFY row_number() OVER (PARTITION BY source, value ORDER BY line_no) = 1""")
_add("dedup_prefix", _pipeline(_fil(r"^(\w+ \w+)", "deduplicate_by_prefix")), r"""
, x AS (SELECT *, CASE WHEN regexp_extract(value, '^([\pL\pN_]+ [\pL\pN_]+)', 1) <> '' THEN 'g' || regexp_extract(value, '^([\pL\pN_]+ [\pL\pN_]+)', 1) ELSE 'l' || value END AS k FROM lines)
SELECT source, line_no, value FROM x QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY line_no) = 1""")
_add("validate_skip", _pipeline({"type": "validate", "pattern": r"\d", "on_mismatch": "skip"}), _V + "regexp_matches(value, '[0-9]')")
QUERIES["validate_errors"] = lambda s, d: engine.run(_pipeline({"type": "validate", "pattern": r"\d"}), lines(s, d)).errors.select("source", "line_no", "step_index", "context")
SQL["validate_errors"] = _LINES + " SELECT source, line_no, 0 AS step_index, value AS context FROM lines WHERE NOT regexp_matches(value, '[0-9]')"
for _name, _sql in {
    "uppercase": "upper(replace(value, 'ß', 'SS'))", "lowercase": "lower(value)", "reverse": "reverse(value)", "char_count": "length(value)::VARCHAR", "base64_encode": "to_base64(encode(value))", "hex_encode": "lower(hex(encode(value)))",
    "remove_whitespace": r"regexp_replace(value, '\s', '', 'g')", "word_count": r"len(list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> ''))::VARCHAR", "normalize_whitespace": r"trim(regexp_replace(value, '\s+', ' ', 'g'))", "trim": r"regexp_replace(regexp_replace(value, '^\s+', ''), '\s+$', '')", "length": "octet_length(encode(value))::VARCHAR",
}.items():
    _add(f"transform_{_name}", _pipeline({"type": "transform", "pattern": ".*", "transform": {"type": _name}}), f"SELECT source, line_no, {_sql} AS value FROM lines")
_add("transform_match", _pipeline({"type": "transform", "pattern": r"\b[a-z]+\d", "transform": "uppercase"}))
_add("transform_mask", _pipeline({"type": "transform", "pattern": r"\d{3,}", "transform": {"type": "mask_deterministic", "seed": "k", "keep_prefix": 1}}))
_add("transform_url", _pipeline({"type": "transform", "pattern": r"/\S+", "transform": "url_encode"}))
_add("transform_fpe", _pipeline({"type": "transform", "pattern": r"\d{4,}", "transform": {"type": "fpe_encrypt", "key": "2b7e151628aed2a6abf7158809cf4f3c", "tweak": "39383736353433323130", "radix": 10}}))
_add("plugin_pascal_case", _pipeline({"type": "transform", "pattern": r"\w+_\w+", "transform": {"type": "plugin", "name": "pascal_case"}}))
_add("context_lines", _pipeline(_fil(r"port \d+"), context_before=2, context_after=1), r"""
, k AS (SELECT *, regexp_matches(value, 'port [0-9]+') AS k FROM lines),
n AS (SELECT *, k OR coalesce(bool_or(k) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) OR coalesce(bool_or(k) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), false) AS near FROM k)
SELECT source, line_no, value FROM n WHERE near""")
_BLOCKS = r"""
, se AS (SELECT *, regexp_matches(value, '^Update|^For now|^#') AS s, value = '' AS e FROM lines),
g AS (SELECT *, count(CASE WHEN s AND NOT e THEN 1 WHEN e AND NOT s THEN 0 END) OVER (PARTITION BY source ORDER BY line_no) AS grp, CASE WHEN s AND NOT e THEN 1 WHEN e AND NOT s THEN 0 END AS st FROM se),
b AS (SELECT *, coalesce(max(st) OVER (PARTITION BY source, grp), 0) AS after FROM g),
w AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY source ORDER BY line_no), 0) = 1 OR s AS inside FROM b) """
_BLOCK = {"type": "block", "start_pattern": r"^Update|^For now|^#", "end_pattern": "^$"}
_add("block_keep", _pipeline({**_BLOCK, "action": "keep_block"}), _BLOCKS + "SELECT source, line_no, value FROM w WHERE inside")
_add("block_drop", _pipeline({**_BLOCK, "action": "drop_block"}), _BLOCKS + "SELECT source, line_no, value FROM w WHERE NOT inside")
_add("block_mark", _pipeline({**_BLOCK, "action": {"mark_block": {"marker": "> "}}}), _BLOCKS + "SELECT source, line_no, CASE WHEN inside THEN '> ' || value ELSE value END AS value FROM w")
_add("block_substitute", _pipeline({**_BLOCK, "action": {"substitute_in_block": {"pattern": r"\d", "replacement": "#"}}}), _BLOCKS + "SELECT source, line_no, CASE WHEN inside THEN regexp_replace(value, '[0-9]', '#', 'g') ELSE value END AS value FROM w")
_add("block_content", _pipeline({**_BLOCK, "pattern": "offset", "action": "keep_block"}))
_add("block_dedup", _pipeline({**_BLOCK, "action": "deduplicate"}))
_add("slurp_substitute", _pipeline(_sub(r"\.\n", ". "), mode="slurp"), r"""
, j AS (SELECT source, regexp_replace(string_agg(value, chr(10) ORDER BY line_no), '\.\n', '. ', 'g') AS v FROM lines GROUP BY source),
z AS (SELECT source, CASE WHEN v = '' THEN [] ELSE string_split(regexp_replace(v, '\n$', ''), chr(10)) END AS a FROM j)
SELECT source, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS value FROM z""")
_add("paragraph_substitute", _pipeline(_sub(r"\A\w+", "¶"), mode="paragraph"))
QUERIES["finalize_counters"] = lambda s, d: engine.counters(lines(s, d), _FINAL)
_FINAL = spec.Finalize(counters=(spec.Counter("ports", r"port \d+"), spec.Counter("releases", r"release (\d+)", deduplicate=True), spec.Counter("hosts", r"[a-z]+-\d\d\.[a-z.]+", collect_values=True, max_collected_values=5)))
SQL["finalize_counters"] = _LINES + r"""
SELECT count(*) AS lines, count(*) FILTER (regexp_matches(value, 'port [0-9]+')) AS ports, count(DISTINCT CASE WHEN regexp_matches(value, 'release ([0-9]+)') THEN regexp_extract(value, 'release ([0-9]+)', 1) END) AS releases,
count(*) FILTER (regexp_matches(value, '[a-z]+-[0-9][0-9]\.[a-z.]+')) AS hosts,
(SELECT list(v ORDER BY source, line_no) FROM (SELECT source, line_no, regexp_extract(value, '[a-z]+-[0-9][0-9]\.[a-z.]+') AS v FROM lines WHERE regexp_matches(value, '[a-z]+-[0-9][0-9]\.[a-z.]+') ORDER BY source, line_no LIMIT 5)) AS hosts_values FROM lines"""
QUERIES["step_stats"] = lambda s, d: engine.run(_pipeline(_fil("the"), _sub(r"\d+", "N"), _fil("offset", "drop_line")), lines(s, d), stats=True).stats
SQL["step_stats"] = _LINES + r"""
, a AS (SELECT *, regexp_replace(value, '[0-9]+', 'N', 'g') AS v2 FROM lines WHERE contains(value, 'the'))
SELECT 0::INT AS step_index, (SELECT count(*) FROM lines) AS lines_in, (SELECT count(*) FROM a) AS lines_out, (SELECT count(*) FROM lines) - (SELECT count(*) FROM a) AS lines_dropped, (SELECT count(*) FROM a) AS matches, 0::BIGINT AS transformations
UNION ALL SELECT 1, (SELECT count(*) FROM a), (SELECT count(*) FROM a), 0, (SELECT sum(len(regexp_extract_all(value, '[0-9]+')))::BIGINT FROM a), (SELECT count(*) FROM a WHERE v2 <> value)
UNION ALL SELECT 2, (SELECT count(*) FROM a), (SELECT count(*) FROM a WHERE NOT contains(v2, 'offset')), (SELECT count(*) FROM a WHERE contains(v2, 'offset')), (SELECT count(*) FROM a WHERE contains(v2, 'offset')), 0"""
QUERIES["source_stats"] = lambda s, d: engine.source_stats(engine.run(_pipeline(_fil("the"), _sub(r"\d+", "N")), lines(s, d)))
SQL["source_stats"] = _LINES + " SELECT source, count(*) AS lines_in, count(*) FILTER (contains(value, 'the')) AS lines_out, count(*) FILTER (contains(value, 'the') AND regexp_matches(value, '[0-9]')) AS changed FROM lines GROUP BY source"
QUERIES["why_dropped"] = lambda s, d: engine.why_dropped(_pipeline(_fil("the"), _fil("offset", "drop_line")), lines(s, d))
SQL["why_dropped"] = _LINES + " SELECT source, line_no, value AS orig, CASE WHEN NOT contains(value, 'the') THEN 0 ELSE 1 END::INT AS dropped_by FROM lines WHERE NOT contains(value, 'the') OR contains(value, 'offset')"
QUERIES["inspect_matches"] = lambda s, d: engine.inspect(_pipeline(_sub(r"release (\d+)", "r$1")), lines(s, d))
QUERIES["discovery_report"] = lambda s, d: discovery.report(lines(s, d), with_examples=False)
_DETECTED = r"""SELECT 'email' AS name, regexp_extract_all(value, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS f FROM lines
UNION ALL SELECT 'ipv4', regexp_extract_all(value, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') FROM lines UNION ALL SELECT 'phone_us', regexp_extract_all(value, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b') FROM lines
UNION ALL SELECT 'date_iso', regexp_extract_all(value, '\b\d{4}-\d{2}-\d{2}\b') FROM lines UNION ALL SELECT 'date_us', regexp_extract_all(value, '\b\d{1,2}/\d{1,2}/\d{4}\b') FROM lines
UNION ALL SELECT 'time_24h', regexp_extract_all(value, '\b\d{1,2}:\d{2}(?::\d{2})?\b') FROM lines UNION ALL SELECT 'uuid', regexp_extract_all(value, '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b') FROM lines
UNION ALL SELECT 'hex_id', regexp_extract_all(value, '\b[0-9a-fA-F]{8,}\b') FROM lines UNION ALL SELECT 'url', regexp_extract_all(value, 'https?://[^\s<>"'']+') FROM lines UNION ALL SELECT 'ssn', regexp_extract_all(value, '\b\d{3}-\d{2}-\d{4}\b') FROM lines
UNION ALL SELECT 'credit_card', regexp_extract_all(value, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b') FROM lines UNION ALL SELECT 'api_key', regexp_extract_all(value, '\b[A-Za-z0-9_-]{20,}\b') FROM lines
UNION ALL SELECT 'base64_blob', regexp_extract_all(value, '\b[A-Za-z0-9+/]{20,}={0,2}\b') FROM lines"""
SQL["discovery_report"] = _LINES + f" SELECT name, sum(len(f))::BIGINT AS matches, count(*) FILTER (len(f) > 0) AS lines FROM ({_DETECTED}) GROUP BY name HAVING sum(len(f)) > 0"
QUERIES["discovery_examples"] = lambda s, d: discovery.report(lines(s, d)).select("name", "examples")
SQL["discovery_examples"] = _LINES + f" SELECT name, list_sort(list_distinct(flatten(list(f))))[1:3] AS examples FROM ({_DETECTED}) GROUP BY name HAVING sum(len(f)) > 0"
_RULES = [crossfile.Rule("limits", r"limit to \d+", "*", "*", "offset"), crossfile.Rule("hosts", r"db-\d\d", "*", "*", "segment")]


def _named(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).withColumn("source", F.col("source").cast("string"))


QUERIES["cross_file_triggers"] = lambda s, d: crossfile.triggers(_named(s, d), _RULES)
SQL["cross_file_triggers"] = _LINES + r" SELECT 'limits' AS rule, source::VARCHAR AS source, line_no, regexp_extract(value, 'limit to [0-9]+') AS matched FROM lines WHERE regexp_matches(value, 'limit to [0-9]+') UNION ALL SELECT 'hosts', source::VARCHAR, line_no, regexp_extract(value, 'db-[0-9][0-9]') FROM lines WHERE regexp_matches(value, 'db-[0-9][0-9]')"
QUERIES["cross_file_check"] = lambda s, d: crossfile.check(_named(s, d), _RULES).select("rule", "related_source", "triggers")
SQL["cross_file_check"] = _LINES + r""", tr AS (SELECT 'limits' AS rule, source FROM lines WHERE regexp_matches(value, 'limit to [0-9]+') UNION ALL SELECT 'hosts', source FROM lines WHERE regexp_matches(value, 'db-[0-9][0-9]')),
f AS (SELECT 'limits' AS rule, source FROM lines GROUP BY source HAVING NOT bool_or(contains(value, 'offset')) UNION ALL SELECT 'hosts', source FROM lines GROUP BY source HAVING NOT bool_or(contains(value, 'segment'))),
n AS (SELECT rule, count(*) AS c FROM tr GROUP BY rule), own AS (SELECT rule, source, count(*) AS c FROM tr GROUP BY ALL)
SELECT f.rule, f.source::VARCHAR AS related_source, (n.c - coalesce(own.c, 0))::BIGINT AS triggers FROM f JOIN n USING (rule) LEFT JOIN own ON own.rule = f.rule AND own.source = f.source WHERE n.c > coalesce(own.c, 0)"""
QUERIES["mapping_current"] = lambda s, d: mapping.current(t(s, d, "mapping_entries"), "original").select("original", "transformed")
SQL["mapping_current"] = "SELECT original, arg_max(transformed, (created_at, step_index, transformed)) AS transformed FROM mapping_entries GROUP BY original"
QUERIES["mapping_reverse"] = lambda s, d: mapping.apply(t(s, d, "mapping_entries").select(F.col("transformed").alias("value")).distinct(), t(s, d, "mapping_entries"), reverse=True)
SQL["mapping_reverse"] = "SELECT transformed AS value, arg_max(original, (created_at, step_index, original)) AS mapped FROM mapping_entries GROUP BY transformed"
QUERIES["mapping_statistics"] = lambda s, d: mapping.statistics(t(s, d, "mapping_entries"))
SQL["mapping_statistics"] = "SELECT count(*) AS entries, count(DISTINCT original) AS originals, count(DISTINCT transformed) AS replacements, count(DISTINCT step_index) AS steps FROM mapping_entries"
QUERIES["mapping_recorded"] = lambda s, d: mapping.record(lines(s, d), spec.step_of(_sub(r"[a-z]+-\d\d\.[a-z.]+", "<host>")), 0)
SQL["mapping_recorded"] = _LINES + r" SELECT DISTINCT m AS original, '<host>' AS transformed, 0::INT AS step_index, '[a-z]+-\d\d\.[a-z.]+' AS pattern, 0::BIGINT AS created_at FROM (SELECT unnest(regexp_extract_all(value, '[a-z]+-[0-9][0-9]\.[a-z.]+')) AS m FROM lines)"
QUERIES["unchanged_files"] = lambda s, d: t(s, d, "source_files").join(incremental.changed_files(t(s, d, "source_files"), t(s, d, "checkpoints"), t(s, d, "pipeline_runs")), F.col("file_id") == F.col("record_id"), "left_anti").select("file_id")
SQL["unchanged_files"] = "SELECT file_id FROM source_files WHERE file_id NOT IN (SELECT record_id FROM (" + SQL["p4_found"] + ") WHERE kind = 'file')"
QUERIES["files_with_matches"] = lambda s, d: sinks.match_counts(lines(s, d), F.col("value").contains("offset")).filter("matches > 0")
SQL["files_with_matches"] = _LINES + " SELECT source, count(*) FILTER (contains(value, 'offset')) AS matches FROM lines GROUP BY source HAVING matches > 0"
QUERIES["annotations"] = lambda s, d: sinks.annotations(lines(s, d).filter(F.col("value").contains("limit"))).select("source", "line_no", "value")
SQL["annotations"] = _LINES + " SELECT source, line_no, '::warning file=' || source || ',line=' || line_no || '::' || value AS value FROM lines WHERE contains(value, 'limit')"
QUERIES["numbered_lines"] = lambda s, d: sinks.numbered(lines(s, d).filter(F.col("value").contains("the")))
SQL["numbered_lines"] = _LINES + " SELECT source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) || ': ' || value AS value FROM lines WHERE contains(value, 'the')"
QUERIES["changed_lines"] = lambda s, d: (lambda r: sinks.changes(r.original, r.lines))(engine.run(_pipeline(_sub(r"\d+", "N"), _fil("^#", "drop_line")), lines(s, d)))
SQL["changed_lines"] = _LINES + " SELECT source, line_no, value AS old, CASE WHEN NOT regexp_matches(value, '^#') THEN regexp_replace(value, '[0-9]+', 'N', 'g') END AS new FROM lines WHERE regexp_matches(value, '^#') OR regexp_matches(value, '[0-9]')"
QUERIES["jsonl_rows"] = lambda s, d: sinks.jsonl(t(s, d, "pipeline_runs").select("run_id", "status"))
SQL["jsonl_rows"] = """SELECT '{"run_id":' || run_id || ',"status":"' || status || '"}' AS value FROM pipeline_runs"""
QUERIES["scoped_strings"] = lambda s, d: syntax.scoped_files(t(s, d, "line_matches"), "extract", r"\w+", ["strings"]).select("source", "result")
QUERIES["range_lines"] = lambda s, d: within_ranges(lines(s, d), t(s, d, "documents").select(F.col("doc_id").alias("source"), F.lit(2).alias("first"), F.lit(4).alias("last")))
SQL["range_lines"] = _LINES + " SELECT source, line_no, value FROM lines WHERE line_no BETWEEN 2 AND 4"
QUERIES["stream_lines"] = lambda s, d: streaming.line_by_line(_pipeline(_fil("the"), _sub(r"\d+", "N")), lines(s, d)).select("source", "line_no", "out")
SQL["stream_lines"] = _LINES + " SELECT source, line_no, CASE WHEN contains(value, 'the') THEN regexp_replace(value, '[0-9]+', 'N', 'g') END AS out FROM lines"
QUERIES["stream_summary"] = lambda s, d: (lambda p: streaming.summary(p, streaming.line_by_line(p, lines(s, d))))(_pipeline(_sub(r"\d+", "N"), _sub("offset", "OFFSET")))
SQL["stream_summary"] = _LINES + " SELECT count(*) AS lines, count(*) FILTER (regexp_matches(value, '[0-9]') OR contains(value, 'offset')) AS matched, count(*) FILTER (regexp_matches(value, '[0-9]')) AS step_0, count(*) FILTER (contains(value, 'offset')) AS step_1 FROM lines"
QUERIES["windowed_events"] = lambda s, d: streaming.windowed_counts(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "1 hour")
SQL["windowed_events"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
QUERIES["commit_messages"] = lambda s, d: discovery.commits(_messages(s, d), "text").filter("type is not null").select("line_id", "type", "scope", "breaking", "description")


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Log lines rewritten as commit messages: the component as the scope, the level as the type."""
    head = r"(?i)^.*\b(error|info|warn|debug)\b[\] ]+([a-z-]+)\.([a-z]+): "
    kind = F.create_map(*[F.lit(x) for x in ("error", "fix", "info", "feat", "warn", "perf!", "debug", "none")])[F.lower(F.regexp_extract("original_line", head, 1))]
    scope = F.concat(F.lit("("), F.regexp_extract("original_line", head, 2), F.lit(")"))
    plain = F.concat(F.replace(kind, F.lit("!"), F.lit("")), scope, F.when(kind.endswith("!"), "!").otherwise(""), F.lit(": "), F.regexp_replace("original_line", head, ""))
    return t(s, d, "line_matches").filter(F.col("original_line").rlike(head)).select("line_id", plain.alias("text"))


SQL["commit_messages"] = r"""WITH m AS (SELECT line_id, lower(regexp_extract(original_line, '(?i)^.*\b(error|info|warn|debug)\b[\] ]+([a-z-]+)\.([a-z]+): ', 1)) AS l, regexp_extract(original_line, '(?i)^.*\b(error|info|warn|debug)\b[\] ]+([a-z-]+)\.([a-z]+): ', 2) AS scope,
regexp_replace(original_line, '(?i)^.*\b(error|info|warn|debug)\b[\] ]+([a-z-]+)\.([a-z]+): ', '') AS description FROM line_matches WHERE regexp_matches(original_line, '(?i)^.*\b(error|info|warn|debug)\b[\] ]+([a-z-]+)\.([a-z]+): '))
SELECT line_id, CASE l WHEN 'error' THEN 'fix' WHEN 'info' THEN 'feat' ELSE 'perf' END AS type, scope, l = 'warn' AS breaking, regexp_extract(description, '[^\n]+') AS description FROM m WHERE l <> 'debug' AND regexp_matches(description, '^[^\n]')"""
# --- log entries beside what the drivers compare -----------------------------------------------------------------------
QUERIES["p1_levels"] = lambda s, d: log_entries.find_entries(t(s, d, "line_matches"), t(s, d, "source_files")).groupBy("component", "level").agg(F.count("*").alias("entries"))
QUERIES["p1_entries"] = lambda s, d: log_entries.full_entries(t(s, d, "line_matches"), t(s, d, "source_files"))

from . import queries_functions, queries_language  # noqa: E402, F401 - they add theirs
