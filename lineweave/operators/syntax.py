"""Scopes of source code: byte-free ranges of strings, comments, code, functions, classes, imports and tests, and operators within them.

Python files are read with ``ast`` and ``tokenize``; other languages with a small lexer for strings and comments, and by
indentation of braces for functions. Which scopes a language has is in SUPPORTED; others raise.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import Pattern, expand, matches, template

Range = tuple[int, int]
SUPPORTED = {
    "python": {"strings", "comments", "code", "functions", "classes", "imports", "tests", "docstrings", "function_calls", "types", "identifiers", "control_flow"},
    **{lang: {"strings", "comments", "code", "functions", "imports", "tests", "function_calls", "types", "identifiers", "macros", "control_flow"} for lang in ("javascript", "typescript", "rust", "go")},
    "json": {"strings", "keys", "values"}, "yaml": {"strings", "comments", "keys", "values"},
}
_LEX = {
    "c": re.compile(r'(?P<comments>//[^\n]*|/\*.*?\*/)|(?P<strings>"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|\'(?:[^\'\\\n]|\\.)*\')', re.S),
    "rust": re.compile(r'(?P<comments>//[^\n]*|/\*.*?\*/)|(?P<strings>r#*".*?"#*|"(?:[^"\\]|\\.)*")', re.S),
    "yaml": re.compile(r'(?P<comments>(?<![^\s])#[^\n]*)|(?P<strings>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\n]|\'\')*\')'),
    "json": re.compile(r'(?P<strings>"(?:[^"\\\n]|\\.)*")'),
}
_FUNCTION = {"javascript": r"\b(?:async\s+)?function\b[^{]*\{|\([^()]*\)\s*=>\s*\{", "typescript": r"\b(?:async\s+)?function\b[^{]*\{|\([^()]*\)[^={]*=>\s*\{", "rust": r"\bfn\s+\w+[^{;]*\{", "go": r"\bfunc\b[^{]*\{"}
_TEST = {"javascript": r"\b(?:describe|it|test)\s*\([^{]*\{", "typescript": r"\b(?:describe|it|test)\s*\([^{]*\{", "rust": r"#\[(?:test|cfg\(test\))\][^{]*\{", "go": r"\bfunc\s+Test\w*[^{]*\{"}
_IMPORT = {"javascript": r"^import[^\n]*", "typescript": r"^import[^\n]*", "rust": r"^\s*use [^;]*;", "go": r"^import (?:\([^)]*\)|[^\n]*)"}


def _merged(ranges: list[Range]) -> list[Range]:
    out: list[Range] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _without(n: int, ranges: list[Range]) -> list[Range]:
    out, at = [], 0
    for a, b in _merged(ranges):
        if a > at:
            out.append((at, a))
        at = b
    return out + ([(at, n)] if at < n else [])


def _python(text: str) -> dict[str, list[Range]]:
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    at = lambda row, col: starts[min(row - 1, len(starts) - 1)] + col
    out: dict[str, list[Range]] = {k: [] for k in SUPPORTED["python"]}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            name = tokenize.tok_name[t.type]
            if name == "STRING" or name.startswith("FSTRING"):
                out["strings"].append((at(*t.start), at(*t.end)))
            elif name == "COMMENT":
                out["comments"].append((at(*t.start), at(*t.end)))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        tree = ast.Module([], [])
    lines = text.splitlines(keepends=True)

    def span(node: ast.AST) -> Range:
        chars = lambda row, col: at(row, len(lines[row - 1].encode()[:col].decode("utf-8", "ignore")))
        return chars(node.lineno, node.col_offset), chars(node.end_lineno, node.end_col_offset)

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out["functions"].append(span(node))
            if node.name.startswith("test"):
                out["tests"].append(span(node))
        elif isinstance(node, ast.ClassDef):
            out["classes"].append(span(node))
            if node.name.startswith("Test"):
                out["tests"].append(span(node))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            out["imports"].append(span(node))
        elif isinstance(node, ast.Call):
            out["function_calls"].append(span(node))
        elif isinstance(node, ast.Name):
            out["identifiers"].append(span(node))
        elif isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.With | ast.AsyncWith | ast.Match | ast.Return | ast.Break | ast.Continue | ast.Raise):
            out["control_flow"].append(span(node))
        for kind in ("annotation", "returns"):
            if isinstance(getattr(node, kind, None), ast.expr):
                out["types"].append(span(getattr(node, kind)))
        if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            out["docstrings"].append(span(node.body[0]))
    return out


# Words of the languages that are no identifiers.
_WORDS = set(
    "if else for while loop match switch case return break continue try catch finally throw new function class extends const let var import export from default async await typeof instanceof in of void delete yield this super "
    "fn pub use mod struct enum impl trait mut ref self Self where dyn move unsafe crate as type static func package interface map chan go defer select range fallthrough goto true false null undefined nil None".split()
)
#: Where a language writes types.
_TYPE = {"javascript": r"\bclass\s+([A-Z]\w*)", "typescript": r"(?:[\w)\]?]\s*:|\bas|\b(?:class|interface|type|implements|extends))\s+([A-Za-z_][\w.]*(?:<[^<>\n]*>)?(?:\[\])*)", "rust": r"(?:[\w)]\s*:|->|\b(?:struct|enum|impl|trait|for))\s*&?(?:mut\s+)?([A-Z][\w:]*(?:<[^<>\n]*>)?|[iu](?:8|16|32|64|128|size)\b|f(?:32|64)\b|bool\b|str\b|char\b)", "go": r"(?:\btype\s+|[\w)]\s+\*?)(int(?:8|16|32|64)?\b|uint\w*|string\b|bool\b|error\b|float(?:32|64)\b|byte\b|rune\b|[A-Z]\w*)"}


def _covered(ranges: list[Range], at: int) -> bool:
    """Whether a place lies in one of the ranges, which are in order."""
    k = bisect_right(ranges, (at, 1 << 62)) - 1
    return k >= 0 and ranges[k][0] <= at < ranges[k][1]


def _braces(text: str, heads: str, quiet: list[Range]) -> list[Range]:
    inside = set()
    for a, b in quiet:
        inside.update(range(a, b))
    out = []
    for m in re.finditer(heads, text):
        if m.start() in inside:
            continue
        depth, i = 1, m.end()
        while i < len(text) and depth:
            if i not in inside:
                depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        out.append((m.start(), i))
    return out


def ranges(text: str, language: str, scope: list[str], exclude: list[str] = ()) -> list[Range]:
    """The merged character ranges of the scopes, without those of ``exclude``; no scope means all of it."""
    if language not in SUPPORTED:
        raise ValueError(f"no scopes for language {language!r}")
    bad = [s for s in [*scope, *exclude] if s not in SUPPORTED[language]]
    if bad:
        raise ValueError(f"{language} has no scopes {bad}")
    if language == "python":
        found = _python(text)
    else:
        lex = _LEX.get(language, _LEX["c"])
        found = {"strings": [], "comments": [], "keys": [], "values": []}
        for m in lex.finditer(text):
            found[m.lastgroup].append(m.span())
        if language == "json":
            found["keys"] = [r for r in found["strings"] if re.match(r"\s*:", text[r[1] :])]
            found["values"] = [m.span(1) for m in re.finditer(r':\s*("(?:[^"\\]|\\.)*"|[\d.eE+-]+|true|false|null)', text)]
        elif language == "yaml":
            found["keys"] = [m.span(1) for m in re.finditer(r"(?m)^[ \t-]*([\w.-]+)(?=:(?:\s|$))", text)]
            found["values"] = [m.span(1) for m in re.finditer(r"(?m)^[ \t-]*[\w.-]+:[ \t]+([^\n#]+)", text)]
        else:
            quiet = sorted(found["strings"] + found["comments"])
            found["functions"] = _braces(text, _FUNCTION[language], quiet)
            found["tests"] = _braces(text, _TEST[language], quiet)
            found["imports"] = [m.span() for m in re.finditer(_IMPORT[language], text, re.M)]
            loud = lambda rx, k=0: [m.span(k) for m in re.finditer(rx, text, re.M) if not _covered(quiet, m.start(k))]
            found["function_calls"] = [r for r in loud(r"(?<![\w.])(?:[A-Za-z_$][\w$]*(?:\.|::))*[A-Za-z_$][\w$]*(?=\()") if re.split(r"\W", text[r[0] : r[1]])[-1] not in _WORDS and not re.search(r"(?:\bfn|\bfunc|\bfunction)\s+$", text[: r[0]][-20:])]
            found["identifiers"] = [r for r in loud(r"(?<![\w$])[A-Za-z_$][\w$]*") if text[r[0] : r[1]] not in _WORDS]
            found["types"] = loud(_TYPE[language], 1)
            found["macros"] = loud(r"\b\w+!(?=\s*[(\[{])|#!?\[[^\]]*\]") if language == "rust" else []
            found["control_flow"] = loud(r"\b(?:if|else|for|while|loop|match|switch|case|return|break|continue|try|catch|throw|select|defer|goto)\b")
    found["code"] = _without(len(text), found.get("strings", []) + found.get("comments", []))
    inside = _merged([r for s in scope for r in found[s]]) if scope else [(0, len(text))]
    if not exclude:
        return inside
    out_of = _without(len(text), [r for s in exclude for r in found[s]])
    return [(max(a, c), min(b, d)) for a, b in inside for c, d in out_of if max(a, c) < min(b, d)]


def in_scope(text: str, p: Pattern, spans: list[Range]):  # noqa: ANN201
    """Matches that lie within one range entirely."""
    return [m for m in matches(p, text) if any(a <= m.start() and m.end() <= b for a, b in spans)]


def rewrite(text: str, p: Pattern, spans: list[Range], make: Callable) -> str:
    out, at = [], 0
    for m in in_scope(text, p, spans):
        out += [text[at : m.start()], make(m)]
        at = m.end()
    return "".join(out) + text[at:]


def scoped(files: DataFrame, operation: str, pattern: str, language: str, scope: list[str], exclude: list[str] = (), replacement: str = "", transform: Callable[[str], str] | None = None) -> DataFrame:
    """``files`` (source, text) with ``result``: the text after ``replace``, ``transform``, ``keep`` or ``drop`` of lines with a
    match, or the matches (``extract``), or whether there is one (``validate``), each within the scopes only."""
    p = Pattern(pattern)
    ranges("", language, scope, exclude)  # names are checked before anything runs

    def one(text: str | None):  # noqa: ANN202
        if text is None:
            return None
        spans = ranges(text, language, scope, exclude)
        if operation == "replace":
            tokens = template(replacement, p)
            return rewrite(text, p, spans, lambda m: expand(tokens, p.python.match(m[0]) or m))
        if operation == "transform":
            return rewrite(text, p, spans, lambda m: transform(m[0]))
        found = in_scope(text, p, spans)
        if operation == "extract":
            return [m[0] for m in found]
        if operation == "validate":
            return bool(found)
        rows = {text.count("\n", 0, m.start()) for m in found}
        return "\n".join(x for n, x in enumerate(text.split("\n")) if (n in rows) == (operation == "keep"))

    kind = {"extract": "array<string>", "validate": "boolean"}.get(operation, "string")
    return files.withColumn("result", F.pandas_udf(lambda s: s.map(one), kind)("text"))


#: Which files are of which language.
ENDINGS = {"python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx"), "rust": ("rs",), "go": ("go",), "json": ("json",), "yaml": ("yaml", "yml")}


def whole_files(line_matches: DataFrame) -> DataFrame:
    """(source, language, text) of the files in a supported language: lines in order, a lost original by its transformed text."""
    ending = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    language = F.coalesce(*[F.when(ending.isin(*e), F.lit(name)) for name, e in ENDINGS.items()])
    lines = line_matches.select(F.col("path").alias("source"), language.alias("language"), "line_number", F.regexp_replace(F.coalesce("original_line", "transformed_line"), r"[\r\n]+$", "").alias("line"))
    one = lines.filter("language is not null and line is not null").groupBy("source", "language", "line_number").agg(F.max("line").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n")
    return one.groupBy("source", "language").agg(text.alias("text"))


def scoped_files(line_matches: DataFrame, operation: str, pattern: str, scope: list[str]) -> DataFrame:
    """``scoped`` over whole files, each in its language; languages without one of the scopes are left out."""
    files, out = whole_files(line_matches), None
    for language in ENDINGS:
        if set(scope) <= SUPPORTED[language]:
            part = scoped(files.filter(F.col("language") == language), operation, pattern, language, scope)
            out = part if out is None else out.unionByName(part)
    return out
