"""Registered queries of the transforms and plugins, with their SQL."""

from __future__ import annotations

from .queries import _add, _fil, _pipeline

_KEY = {"key": "2b7e151628aed2a6abf7158809cf4f3c", "tweak": "39383736353433323130", "radix": 10}


def _step(pattern: str, transform: object, **more: object) -> dict:
    return {"type": "transform", "pattern": pattern, "transform": transform, **more}


def _plugin(name: str, *args: object) -> dict:
    return {"type": "plugin", "name": name, "args": list(args)}


def _value(name: str, steps: list[dict], sql: str, where: str = "true") -> None:
    """A query whose lines keep their numbers: ``sql`` gives the new value."""
    _add(name, _pipeline(*steps), f"SELECT source, line_no, {sql} AS value FROM lines WHERE {where}")


_ASCII = r"regexp_full_match(value, '[\x00-\x7F]*')"
_only_ascii = _fil(r"^[\x00-\x7F]*$")
_number = {"type": "extract", "pattern": r"\b\d{1,9}\b", "first_only": True}
_N = r"CAST(regexp_extract(value, '\b[0-9]{1,9}\b') AS BIGINT)"
_HAS_N = r"regexp_matches(value, '\b[0-9]{1,9}\b')"
_WORDS = r"list_filter(string_split(replace(replace(value, '_', ' '), '-', ' '), ' '), lambda w: w <> '')"
_CAP = "upper(w[1]) || lower(w[2:])"
_word = {"type": "extract", "pattern": r"[a-z]+[-_][a-z]+[a-z_-]*", "first_only": True}
_W = r"regexp_extract(value, '[a-z]+[-_][a-z]+[a-z_-]*')"
_HAS_W = r"regexp_matches(value, '[a-z]+[-_][a-z]+[a-z_-]*')"

# --- transforms
_value("transform_prepend", [_step(r"port \d+", {"type": "prepend", "text": "<5$1>"})], r"regexp_replace(value, '(port [0-9]+)', '<5$1>\1', 'g')")
_value("transform_append", [_step(r"port \d+", "append", replacement="5!")], r"regexp_replace(value, '(port [0-9]+)', '\1' || '5!', 'g')")
_value("transform_prepend_line", [_step(".*", "prepend", replacement="> ")], "'> ' || value")
_value("transform_title_case", [_only_ascii, _step(".*", "title_case")], f"array_to_string(list_transform(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> ''), lambda w: {_CAP}), ' ')", _ASCII)
_value("transform_base64_decode", [_step(".*", "base64_encode"), _step(".*", "base64_decode")], "value")
_value("transform_base64_invalid", [_step(".*", "base64_decode"), _fil("[^A-Za-z0-9+/=]")], "value", "regexp_matches(value, '[^A-Za-z0-9+/=]')")
_value("transform_url_encode", [_step(".+", "url_encode")], r"array_to_string(list_transform(string_split(value, ''), lambda c: CASE WHEN c = '' OR regexp_full_match(c, '[A-Za-z0-9_.~-]') THEN c ELSE '%' || format('{:02X}', unicode(c)) END), '')")
_value("transform_url_decode", [_only_ascii, _step(".+", "url_encode"), _step(".+", "url_decode")], "value", _ASCII)
_add(
    "transform_deduplicate", _pipeline(_only_ascii, {"type": "extract", "pattern": r"\b[a-z]{3,}\b", "replacement": "\n"}, _step("(?s).+", "deduplicate")),
    r", w AS (SELECT source, line_no, regexp_extract_all(value, '\b[a-z]{3,}\b') AS a FROM lines WHERE regexp_full_match(value, '[\x00-\x7F]*')) SELECT source, line_no, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), chr(10)) AS value FROM w WHERE len(a) > 0",
)
_value("transform_sort_chars", [_step(".*", "sort_chars")], "array_to_string(list_sort(string_split(value, '')), '')")
_value("transform_fpe_round_trip", [_step(r"\d{4,}", {"type": "fpe_encrypt", **_KEY}), _step(r"\d{4,}", {"type": "fpe_decrypt", **_KEY})], "value")
_value("transform_mask_char", [_step(".+", {"type": "mask_deterministic", "seed": "k", "mask_char": "x", "keep_prefix": 2, "keep_suffix": 1})], "CASE WHEN length(value) > 3 THEN value[1:2] || repeat('x', length(value) - 3) || right(value, 1) ELSE value END")
_value("transform_first_match", [_step("offset", "uppercase", flags=["unicode"])], "regexp_replace(value, 'offset', 'OFFSET')")
# --- plugins
_value("plugin_reverse", [_step(".*", _plugin("reverse"))], "reverse(value)")
_value("plugin_repeat", [_step(".*", _plugin("repeat", 3))], "value || value || value")
_value("plugin_slice", [_step(".*", _plugin("slice", 2, 7))], "substr(value, 3, 5)")
_value("plugin_pad_left", [_step(".*", _plugin("pad_left", 40, "."))], "replace(CASE WHEN length(value) < 40 THEN lpad(value, 40, ' ') ELSE value END, ' ', '.')")
_value("plugin_pad_right", [_step(".*", _plugin("pad_right", 40, "."))], "replace(CASE WHEN length(value) < 40 THEN rpad(value, 40, ' ') ELSE value END, ' ', '.')")
_value("plugin_truncate", [_step(".*", _plugin("truncate", 20))], "CASE WHEN length(value) > 20 THEN value[1:20] || '...' ELSE value END")
_value("plugin_snake_case", [_step(".*", _plugin("snake_case"))], r"lower(value[1] || regexp_replace(value[2:], '(\p{Lu})', '_\1', 'g'))")
_value("plugin_kebab_case", [_step(".*", _plugin("kebab_case"))], r"replace(replace(lower(value[1] || regexp_replace(value[2:], '(\p{Lu})', '-\1', 'g')), ' ', '-'), '_', '-')")
_value("plugin_camel_case", [_word, _step(".+", _plugin("camel_case"))], f"array_to_string(list_transform({_WORDS.replace('value', _W)}, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE {_CAP} END), '')", _HAS_W)
_value("plugin_pascal_words", [_word, _step(".+", _plugin("pascal_case"))], f"array_to_string(list_transform({_WORDS.replace('value', _W)}, lambda w: {_CAP}), '')", _HAS_W)
_value("plugin_length", [_step(".*", _plugin("length"))], "octet_length(encode(value))::VARCHAR")
_value("plugin_word_count", [_step(".*", _plugin("word_count"))], r"len(list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> ''))::VARCHAR")
_add(
    "plugin_line_count", _pipeline({"type": "extract", "pattern": r"\d+", "replacement": "\n"}, _step("(?s).+", _plugin("line_count"))),
    "SELECT source, line_no, len(regexp_extract_all(value, '[0-9]+'))::VARCHAR AS value FROM lines WHERE regexp_matches(value, '[0-9]')",
)
_add(
    "plugin_char_freq", _pipeline(_fil("."), _step("(?s).+", _plugin("char_freq"))),
    """, c AS (SELECT source, line_no, unnest(string_split(value, '')) AS c FROM lines WHERE value <> ''), n AS (SELECT source, line_no, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, line_no ORDER BY n DESC, unicode(c)) AS r FROM n) SELECT source, line_no, string_agg(c || ':' || n, ',' ORDER BY r) AS value FROM r WHERE r <= 5 GROUP BY source, line_no""",
)
_value("plugin_hex_encode", [_step(".*", _plugin("hex_encode"))], "lower(hex(encode(value)))")
_value("plugin_hex_decode", [_step(".+", _plugin("hex_encode")), _step(".+", _plugin("hex_decode"))], "value")
_value("plugin_squeeze", [_only_ascii, _step(".*", _plugin("squeeze"))], r"regexp_replace(value, '\s+', ' ', 'g')", _ASCII)
_value("plugin_strip_prefix", [_step(".*", _plugin("strip_prefix", "The "))], "CASE WHEN starts_with(value, 'The ') THEN value[5:] ELSE value END")
_value("plugin_strip_suffix", [_step(".*", _plugin("strip_suffix", "."))], "CASE WHEN suffix(value, '.') THEN value[:-2] ELSE value END")
_value("plugin_increment", [_number, _step(".+", _plugin("increment", 7))], f"({_N} + 7)::VARCHAR", _HAS_N)
_value("plugin_decrement", [_number, _step(".+", _plugin("decrement"))], f"({_N} - 1)::VARCHAR", _HAS_N)
_value("plugin_format_number", [_number, _step(".+", _plugin("format_number"))], f"format('{{:,}}', {_N})", _HAS_N)
_add(
    "plugin_transpose", _pipeline(_only_ascii, {"type": "extract", "pattern": r"\b[A-G]\b", "first_only": True}, _step(".+", _plugin("transpose", 2))),
    r", x AS (SELECT source, line_no, regexp_extract(value, '\b[A-G]\b') AS n FROM lines WHERE regexp_full_match(value, '[\x00-\x7F]*') AND regexp_matches(value, '\b[A-G]\b')) SELECT source, line_no, MAP {'A': 'B', 'B': 'C#', 'C': 'D', 'D': 'E', 'E': 'F#', 'F': 'G', 'G': 'A'}[n] AS value FROM x",
)
