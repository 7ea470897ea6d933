"""More registered queries of the pipeline language: numbers, renderings, whole texts, blocks, statistics, cross-file fixes, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import engine, spec, streaming
from .operators import crossfile, mapping, ordered
from .plans import table as t
from .queries import _BLOCK, _BLOCKS, _LINES, _RULES, QUERIES, SQL, _add, _fil, _named, _pipeline, _sub, lines
from .sources import sinks

# --- running numbers
_SEQ = """, n AS (SELECT source, line_no, value, string_split(value, 'offset') AS a, len(string_split(value, 'offset')) - 1 AS k FROM lines),
b AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM n)
SELECT source, line_no, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 THEN x ELSE 'offset#' || (b + i - 1) || x END), '') AS value FROM b"""
SQL["seq_numbers"] = _LINES + _SEQ
_add("count_numbers", _pipeline(_sub("offset", "offset#${count}")), _SEQ)
_add("count_over_steps", _pipeline(_sub("offset", "offset#${count}"), _fil("^#", "drop_line"), _sub("limit", "limit#${count}/${seq}")), """
, n AS (SELECT source, line_no, value, string_split(value, 'offset') AS a, len(string_split(value, 'offset')) - 1 AS k0, CASE WHEN value[1] = '#' THEN 0 ELSE len(string_split(value, 'limit')) - 1 END AS k1 FROM lines),
w AS (SELECT *, coalesce(sum(k0 + k1) OVER p, 0)::BIGINT AS b, coalesce(sum(k1) OVER p, 0)::BIGINT AS s FROM n WINDOW p AS (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT source, line_no, b + k0 AS b, s, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 THEN x ELSE 'offset#' || (b + i - 1) || x END), '') AS v FROM w WHERE value[1] IS DISTINCT FROM '#')
SELECT source, line_no, array_to_string(list_transform(string_split(v, 'limit'), lambda x, i: CASE WHEN i = 1 THEN x ELSE 'limit#' || (b + i - 1) || '/' || (s + i - 1) || x END), '') AS value FROM v""")

# --- renderings of an extract step; the pattern's groups hold letters and digits only
_M = r""", m AS (SELECT source, line_no, regexp_extract_all(value, '([a-z]+) ([0-9]+)', 1) AS w, regexp_extract_all(value, '([a-z]+) ([0-9]+)', 2) AS n FROM lines),
z AS (SELECT source, line_no, list_zip(w, n) AS z FROM m WHERE len(w) > 0) SELECT source, line_no, """
_pairs = {"type": "extract", "pattern": r"([a-z]+) (\d+)"}
_OBJECT = """'{"word":"' || p[1] || '","number":"' || p[2] || '"}'"""
_add("extract_template", _pipeline({**_pairs, "output_template": "$2:${word}", "capture_names": ["word", "number"]}), _M + "array_to_string(list_transform(z, lambda p: p[2] || ':' || p[1]), chr(10)) AS value FROM z")
_add("extract_json", _pipeline({**_pairs, "output_format": "json", "capture_names": ["word", "number"]}), _M + f"'[' || array_to_string(list_transform(z, lambda p: {_OBJECT}), ',') || ']' AS value FROM z")
_add("extract_jsonl", _pipeline({**_pairs, "output_format": "jsonl", "capture_names": ["word", "number"]}), _M + f"array_to_string(list_transform(z, lambda p: {_OBJECT}), chr(10)) AS value FROM z")
_add("extract_json_groups", _pipeline({**_pairs, "output_format": "jsonl"}), _M + """array_to_string(list_transform(z, lambda p: '{"group_0":"' || p[1] || ' ' || p[2] || '","group_1":"' || p[1] || '","group_2":"' || p[2] || '"}'), chr(10)) AS value FROM z""")
_add("extract_csv", _pipeline({**_pairs, "output_format": "csv"}), _M + "array_to_string(list_transform(z, lambda p: p[1] || ',' || p[2]), chr(10)) AS value FROM z")
_add("extract_csv_header", _pipeline({**_pairs, "output_format": "csv", "capture_names": ["word", "number"]}), _M + "CASE WHEN row_number() OVER (PARTITION BY source ORDER BY line_no) = 1 THEN 'word,number' || chr(10) ELSE '' END || array_to_string(list_transform(z, lambda p: p[1] || ',' || p[2]), chr(10)) AS value FROM z")
_DEDUP = {"type": "extract", "pattern": r"[a-z]+\.[a-z]+\b", "first_only": True, "deduplicate": True}
QUERIES["extract_dedup_stats"] = lambda s, d: engine.run(_pipeline(_DEDUP), lines(s, d), stats=True).lines
SQL["extract_dedup_stats"] = SQL["extract_dedup"]

# --- steps on whole texts
_JOINED = ", j AS (SELECT source, string_agg(value, chr(10) ORDER BY line_no) AS v FROM lines GROUP BY source), o AS (SELECT source, {} AS v FROM j),\nz AS (SELECT source, CASE WHEN v = '' THEN [] ELSE string_split(regexp_replace(v, '\\n$', ''), chr(10)) END AS a FROM o) SELECT source, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS value FROM z"
_add("slurp_filter_keep", _pipeline(_fil("offset"), mode="slurp"), _JOINED.format("CASE WHEN contains(v, 'offset') THEN v ELSE '' END"))
_add("slurp_filter_drop", _pipeline(_fil("offset", "drop_line"), mode="slurp"), _JOINED.format("CASE WHEN contains(v, 'offset') THEN '' ELSE v END"))
_add("slurp_drop_match", _pipeline(_fil(r"offset \d+", "drop_match"), mode="slurp"), _JOINED.format("regexp_replace(v, 'offset [0-9]+', '', 'g')"))
_add("slurp_extract", _pipeline({"type": "extract", "pattern": r"\.\n[A-Z]"}, mode="slurp"), _JOINED.format(r"array_to_string(regexp_extract_all(v, '\.\n[A-Z]'), chr(10))"))
_add("slurp_limit", _pipeline(_sub(r"\.\n", ". "), mode="slurp", sample_limit=3), _JOINED.replace("FROM lines GROUP", "FROM lines WHERE line_no <= 3 GROUP").format(r"regexp_replace(v, '\.\n', '. ', 'g')"))
SQL["paragraph_substitute"] = _LINES + _JOINED.format(r"array_to_string(list_transform(string_split(v, chr(10) || chr(10)), lambda x: regexp_replace(x, '\A[\pL\pM\pN_]+', '¶')), chr(10) || chr(10))")
_add("paragraph_filter", _pipeline(_fil("limit"), mode="paragraph"), _JOINED.format(r"array_to_string(list_transform(string_split(v, chr(10) || chr(10)), lambda x: CASE WHEN contains(x, 'limit') THEN x ELSE '' END), chr(10) || chr(10))"))
_add("segments_mixed", _pipeline(_sub("offset", "OFFSET"), _sub(r"\.\n", ". ", mode="slurp"), _fil("OFFSET")), """, j AS (SELECT source, regexp_replace(string_agg(replace(value, 'offset', 'OFFSET'), chr(10) ORDER BY line_no), '\\.\\n', '. ', 'g') AS v FROM lines GROUP BY source),
z AS (SELECT source, CASE WHEN v = '' THEN [] ELSE string_split(regexp_replace(v, '\\n$', ''), chr(10)) END AS a FROM j), y AS (SELECT source, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS value FROM z) SELECT * FROM y WHERE contains(value, 'OFFSET')""")

# --- limits and escapes
_add("max_line_truncate", _pipeline(_sub("e", "E"), max_line_length=60, max_line_action="truncate"), "SELECT source, line_no, replace(CASE WHEN octet_length(encode(value)) + 1 > 60 THEN value[1:list_max(list_filter(range(0, 61), lambda k: octet_length(encode(value[1:k])) <= 60))] ELSE value END, 'e', 'E') AS value FROM lines")
QUERIES["max_line_errors"] = lambda s, d: engine.run(_pipeline(_sub("e", "E"), max_line_length=200, max_line_action="error"), lines(s, d)).errors.select("source", "line_no", "error_type", "context")
SQL["max_line_errors"] = _LINES + " SELECT source, line_no, 'line_too_long' AS error_type, value AS context FROM lines WHERE octet_length(encode(value)) + 1 > 200"
QUERIES["strip_ansi_logs"] = lambda s, d: engine.run(_pipeline(_fil("."), strip_ansi=True), t(s, d, "line_matches").select(F.col("line_id").alias("source"), F.col("line_number").alias("line_no"), F.col("original_line").alias("value"))).lines
SQL["strip_ansi_logs"] = r"""WITH v AS (SELECT line_id AS source, line_number AS line_no, regexp_replace(original_line, '\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[PX^_].*?\x1b\\|[@-Z\\-_])', '', 'g') AS value FROM line_matches WHERE original_line IS NOT NULL) SELECT * FROM v WHERE regexp_matches(value, '[^\n]')"""
QUERIES["validate_warn"] = lambda s, d: engine.run(_pipeline({"type": "validate", "pattern": r"\d", "on_mismatch": "warn"}, _fil("the")), lines(s, d)).lines
SQL["validate_warn"] = _LINES + " SELECT source, line_no, value FROM lines WHERE contains(value, 'the')"

# --- blocks
_IDS = _BLOCKS + """, i AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY source ORDER BY line_no), 0) AS was FROM w),
k AS (SELECT *, sum(CASE WHEN was = 0 AND s THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS id, was = 1 AND e AS leaving, was = 0 AND s AS entering FROM i),
x AS (SELECT source, id, bool_or(leaving) AS ended, bool_or(contains(value, 'offset') AND NOT leaving) AS has, string_agg(value, chr(10) ORDER BY line_no) AS text FROM k WHERE inside GROUP BY source, id) """
SQL["block_content"] = _LINES + _IDS + "SELECT k.source, line_no, value FROM k JOIN x ON x.source = k.source AND x.id = k.id WHERE inside AND ended AND has"
_add("block_content_drop", _pipeline({**_BLOCK, "pattern": "offset", "action": "drop_block"}), _IDS + "SELECT k.source, line_no, value FROM k LEFT JOIN x ON x.source = k.source AND x.id = k.id AND inside WHERE NOT inside OR (ended AND NOT has)")
SQL["block_dedup"] = _LINES + _IDS + ", f AS (SELECT source, id FROM x QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY id) = 1) SELECT k.source, line_no, value FROM k LEFT JOIN f ON f.source = k.source AND f.id = k.id WHERE NOT inside OR f.id IS NOT NULL"
_add("block_collect", _pipeline({**_BLOCK, "action": "collect_block"}), "SELECT * FROM lines")
_TAILS = _IDS + ", t AS (SELECT source, id + 1 AS id, {} AS tail FROM k WHERE leaving) SELECT k.source, line_no, CASE WHEN entering AND tail IS NOT NULL THEN tail || value ELSE value END AS value FROM k LEFT JOIN t ON t.source = k.source AND t.id = k.id"
_HASH = {"type": "block", "start_pattern": "^Update|^For now|^#", "end_pattern": r"^[^UF#].*\.$"}
_add("block_overlap", _pipeline({**_HASH, "block_context": {"overlap_chars": 5}}), _TAILS.replace("value = '' AS e", r"regexp_matches(value, '^[^UF#].*\.$') AS e").format("right(value, 5)"))
_add("block_overlap_lines", _pipeline({**_HASH, "block_context": {"overlap_lines": 1}}), _TAILS.replace("value = '' AS e", r"regexp_matches(value, '^[^UF#].*\.$') AS e").format("value"))
QUERIES["block_stats"] = lambda s, d: engine.run(_pipeline({**_BLOCK, "action": "collect_block"}, {**_BLOCK, "action": {"mark_block": {"marker": "> "}}}), lines(s, d), stats=True).stats
SQL["block_stats"] = _LINES + _IDS + """, c AS (SELECT count(*) AS n, count(*) FILTER (inside) AS inside, count(*) FILTER (entering) AS entered FROM k)
SELECT 0::INT AS step_index, n AS lines_in, n AS lines_out, 0::BIGINT AS lines_dropped, entered + inside AS matches, 0::BIGINT AS transformations FROM c UNION ALL SELECT 1, n, n, 0, entered, inside FROM c"""
QUERIES["unused_steps"] = lambda s, d: engine.unused_steps(engine.run(_pipeline({**_BLOCK, "action": "collect_block"}, _sub("no such text", ""), _fil("nor this", "drop_line")), lines(s, d), stats=True).stats)
SQL["unused_steps"] = "SELECT unnest([1, 2])::INT AS step_index"

# --- what a run did
_SMALL = (_fil("the"), _sub(r"\d+", "N"), {"type": "validate", "pattern": "[a-z]"})
QUERIES["pipeline_stats"] = lambda s, d: engine.pipeline_stats(engine.run(_pipeline(*_SMALL), lines(s, d), stats=True))
_DID = _LINES + """, a AS (SELECT *, regexp_replace(value, '[0-9]+', 'N', 'g') AS new, len(regexp_extract_all(value, '[0-9]+')) AS m FROM lines), k AS (SELECT * FROM a WHERE contains(value, 'the'))"""
SQL["pipeline_stats"] = _DID + """ SELECT (SELECT count(*) FROM lines) AS lines_processed, count(*) AS lines_output, (SELECT count(*) FROM lines) - count(*) AS lines_dropped, (2 * count(*) + sum(m))::BIGINT AS matches_found,
count(*) FILTER (new <> value) AS transformations_applied, 0::BIGINT AS errors, 1.0::DOUBLE AS success_rate FROM k"""
QUERIES["source_totals"] = lambda s, d: engine.totals(engine.source_stats(engine.run(_pipeline(*_SMALL[:2]), lines(s, d), stats=True)), skipped=3)
SQL["source_totals"] = _DID + """, f AS (SELECT source, count(*) AS n, count(*) FILTER (contains(value, 'the')) AS k, sum(CASE WHEN contains(value, 'the') THEN m + 1 ELSE 0 END) AS m, count(*) FILTER (contains(value, 'the') AND new <> value) AS c FROM a GROUP BY source)
SELECT count(*) AS files_processed, count(*) FILTER (m > 0) AS files_matched, count(*) FILTER (c > 0 OR k < n) AS files_modified, 3::BIGINT AS files_skipped, sum(m)::BIGINT AS total_matches, sum(n)::BIGINT AS total_lines FROM f"""
QUERIES["why_lines"] = lambda s, d: engine.why(_pipeline(*_SMALL[:2]), lines(s, d), r"port N")[0]
SQL["why_lines"] = _DID + " SELECT source, line_no, new AS value FROM k WHERE contains(new, 'port N')"
QUERIES["intermediate_lines"] = lambda s, d: dict(engine.intermediates(_pipeline(*_SMALL[:2]), lines(s, d)))[0]
SQL["intermediate_lines"] = _DID + " SELECT source, line_no, value FROM k"
QUERIES["inspect_matches"] = lambda s, d: engine.inspect(_pipeline(_sub(r"release (\d+)", "r$1")), lines(s, d))
SQL["inspect_matches"] = _LINES + """, m AS (SELECT source, line_no, regexp_split_to_array(value, 'release [0-9]+') AS p, regexp_extract_all(value, 'release [0-9]+') AS f FROM lines), u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)
SELECT source, line_no, 0::INT AS step_index, (list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: octet_length(encode(x)))), 0))::BIGINT AS start_byte,
(list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + list_sum(list_transform(f[1:i], lambda x: octet_length(encode(x)))))::BIGINT AS end_byte, f[i] AS full_match, [f[i], f[i][9:]] AS captures, 'r' || f[i][9:] AS replacement_preview FROM u"""
QUERIES["inspection_totals"] = lambda s, d: engine.inspection_totals(engine.inspect(_pipeline(_sub(r"release (\d+)", "r$1"), _fil("offset")), lines(s, d)))
SQL["inspection_totals"] = _LINES + " SELECT 0::INT AS step_index, sum(len(regexp_extract_all(value, 'release [0-9]+')))::BIGINT AS matches FROM lines UNION ALL SELECT 1, sum(len(string_split(value, 'offset')) - 1)::BIGINT FROM lines"
_END = spec.Finalize(template="${lines} lines, ${count:ports} ports", output_format="json", counters=(spec.Counter("ports", r"port \d+"), spec.Counter("releases", r"release (\d+)", deduplicate=True)))
QUERIES["finalize_json"] = lambda s, d: s.createDataFrame([(engine.render_summary(engine.counters(lines(s, d), _END).first().asDict(), _END, 3, 2),)], "value string")
SQL["finalize_json"] = _LINES + r""" SELECT '{"lines_processed": ' || count(*) || ', "total_matches": 3, "total_transformations": 2, "counters": {"ports": {"count": ' || count(*) FILTER (regexp_matches(value, 'port [0-9]+')) || '}, "releases": {"count": ' ||
count(DISTINCT CASE WHEN regexp_matches(value, 'release ([0-9]+)') THEN regexp_extract(value, 'release ([0-9]+)', 1) END) || ', "unique": true}}}' AS value FROM lines"""
QUERIES["presets_logs"] = lambda s, d: engine.run(spec.preset("log"), t(s, d, "line_matches").select(F.col("line_id").alias("source"), F.col("line_number").alias("line_no"), F.col("original_line").alias("value"))).lines
SQL["presets_logs"] = "SELECT line_id AS source, line_number AS line_no, original_line AS value FROM line_matches WHERE regexp_matches(original_line, 'ERROR|FATAL|CRITICAL|PANIC|WARN|WARNING|Exception|Traceback|Stack trace')"
QUERIES["running_numbers"] = lambda s, d: ordered.prefix_sum(lines(s, d), F.char_length("value"), "upto").select("source", "line_no", "upto")
SQL["running_numbers"] = _LINES + " SELECT source, line_no, sum(length(value)) OVER (PARTITION BY source ORDER BY line_no)::BIGINT AS upto FROM lines"

# --- ways back, streams
_THERE = spec.from_dict({"step": [_sub("offset", "<<O>>"), {"type": "transform", "pattern": ".+", "transform": "base64_encode"}]})
QUERIES["reversed_pipeline"] = lambda s, d: engine.run(mapping.reversed_pipeline(_THERE), engine.run(_THERE, lines(s, d)).lines).lines
SQL["reversed_pipeline"] = _LINES + " SELECT * FROM lines"
QUERIES["mapping_strict"] = lambda s, d: mapping.apply(t(s, d, "samples").select(F.col("email").alias("value")).filter("value is not null").distinct(), t(s, d, "mapping_entries"), strict=True)
SQL["mapping_strict"] = "WITH m AS (SELECT original, arg_max(transformed, (created_at, step_index, transformed)) AS transformed FROM mapping_entries GROUP BY original) SELECT DISTINCT email AS value, transformed AS mapped FROM samples LEFT JOIN m ON original = email WHERE email IS NOT NULL"
QUERIES["mapping_ambiguous"] = lambda s, d: mapping.ambiguous(t(s, d, "mapping_entries"))
SQL["mapping_ambiguous"] = "SELECT transformed, count(DISTINCT original) AS originals FROM mapping_entries GROUP BY transformed HAVING count(DISTINCT original) > 1"
QUERIES["stream_rates"] = lambda s, d: (lambda p: streaming.rates(p, streaming.line_by_line(p, lines(s, d))))(_pipeline(_sub(r"\d+", "N")))
SQL["stream_rates"] = _LINES + " SELECT count(*) AS lines, count(*) FILTER (regexp_matches(value, '[0-9]')) AS matched, 100.0::DOUBLE * count(*) FILTER (regexp_matches(value, '[0-9]')) / count(*) AS match_rate FROM lines"

# --- rules over several files
QUERIES["cross_file_fixes"] = lambda s, d: crossfile.fixes(_named(s, d), _RULES)
SQL["cross_file_fixes"] = (
    _LINES + r""", tr AS (SELECT 'limits' AS rule, source::VARCHAR AS source, line_no, regexp_extract(value, 'limit to [0-9]+') AS m FROM lines WHERE regexp_matches(value, 'limit to [0-9]+') UNION ALL SELECT 'hosts', source::VARCHAR, line_no, regexp_extract(value, 'db-[0-9][0-9]') FROM lines WHERE regexp_matches(value, 'db-[0-9][0-9]')),
f AS (SELECT 'limits' AS rule, source::VARCHAR AS source FROM lines GROUP BY source HAVING NOT bool_or(contains(value, 'offset')) UNION ALL SELECT 'hosts', source::VARCHAR FROM lines GROUP BY source HAVING NOT bool_or(contains(value, 'segment'))),
bad AS (SELECT f.rule, f.source FROM f WHERE EXISTS (SELECT 1 FROM tr WHERE tr.rule = f.rule AND tr.source <> f.source)),
one AS (SELECT rule, m, min((source, line_no)) AS k FROM tr GROUP BY rule, m),
every AS (SELECT bad.source, m, min(k) AS k FROM bad JOIN one USING (rule) GROUP BY bad.source, m)
SELECT source AS related_source, string_agg(m, chr(10) ORDER BY k, m) AS appended FROM every GROUP BY source"""
)
_ATOMIC = [crossfile.Rule("limits", r"limit to \d+", "*", "*7", "offset", atomic=True), crossfile.Rule("hosts", r"db-\d\d", "*", "*8", "segment", atomic=True)]
QUERIES["cross_file_groups"] = lambda s, d: (lambda n: crossfile.groups(crossfile.triggers(n, _ATOMIC), n, _ATOMIC))(_named(s, d))
SQL["cross_file_groups"] = _LINES + r""", g AS (SELECT 1 AS o, source::VARCHAR AS source FROM lines WHERE regexp_matches(value, 'limit to [0-9]+') UNION ALL SELECT 2, source::VARCHAR FROM lines WHERE regexp_matches(value, 'db-[0-9][0-9]')
UNION ALL SELECT 1, source::VARCHAR FROM lines WHERE source % 10 = 7 AND EXISTS (SELECT 1 FROM lines WHERE regexp_matches(value, 'limit to [0-9]+')) UNION ALL SELECT 2, source::VARCHAR FROM lines WHERE source % 10 = 8 AND EXISTS (SELECT 1 FROM lines WHERE regexp_matches(value, 'db-[0-9][0-9]')))
SELECT ['limits', 'hosts'][min(o)] AS rule, source FROM g GROUP BY source"""

# --- sinks
QUERIES["documents_again"] = lambda s, d: sinks.as_documents(engine.run(_pipeline(_sub("offset", "OFFSET")), lines(s, d)).lines)
SQL["documents_again"] = _LINES + " SELECT source, string_agg(replace(value, 'offset', 'OFFSET'), chr(10) ORDER BY line_no) || chr(10) AS text FROM lines GROUP BY source"
QUERIES["file_results_jsonl"] = lambda s, d: sinks.file_results(t(s, d, "file_results"))
SQL["file_results_jsonl"] = """SELECT '{"path":"' || path || '","matches_found":' || matches_found || ',"lines_processed":' || lines_processed || ',"modified":' || modified || ',"error":' || CASE WHEN error IS NULL THEN 'null' ELSE '"' || replace(replace(error, '\\', '\\\\'), '"', '\\"') || '"' END || '}' AS value FROM file_results
UNION ALL SELECT '{"files_processed":' || count(*) || ',"files_matched":' || count(*) FILTER (matches_found > 0) || ',"files_modified":' || count(*) FILTER (modified) || ',"total_matches":' || sum(matches_found) || ',"total_lines":' || sum(lines_processed) || '}' FROM file_results"""
QUERIES["files_without_matches"] = lambda s, d: sinks.match_counts(lines(s, d), F.col("value").contains("offset")).filter("matches = 0").select("source")
SQL["files_without_matches"] = _LINES + " SELECT source FROM lines GROUP BY source HAVING NOT bool_or(contains(value, 'offset'))"
