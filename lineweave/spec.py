"""Pipeline definitions in TOML or JSON: steps, settings, shorthand sections, inheritance, checks."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from . import library as lib
from .functions.regex import Pattern
from .functions.transforms import known as known_transform

TYPES = ("filter", "substitute", "extract", "validate", "transform", "block")


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    pcre_mode: bool = False
    fixed_strings: bool = False
    context_before: int = 0
    context_after: int = 0
    timeout_ms: int = 0
    allow_shell: bool = False
    strict_mode: bool = False
    mode: str = "line"
    max_slurp_size: int = 256 << 20
    preserve_line_endings: bool = False
    max_line_length: int = 0
    max_line_action: str = "skip"
    shell_timeout_secs: int = 30
    regex_size_limit: int = 10 << 20
    invert_match: bool = False
    sample_limit: int = 0
    strip_ansi: bool = False


@dataclass(frozen=True)
class Step:
    type: str = "substitute"
    pattern: str = ""
    mode: str | None = None
    not_pattern: str | None = None
    replacement: str | None = None
    action: Any = None
    transform: dict | None = None
    flags: tuple[str, ...] | None = None
    name: str | None = None
    description: str | None = None
    enabled: bool = True
    start_pattern: str | None = None
    end_pattern: str | None = None
    block_context: dict | None = None
    on_mismatch: str | None = None
    languages: tuple[str, ...] = ()
    scope: tuple[str, ...] = ()
    exclude_scopes: tuple[str, ...] = ()
    capture_names: tuple[str, ...] = ()
    output_format: str = "text"
    output_template: str | None = None
    first_only: bool = False
    deduplicate: bool = False

    @property
    def is_global(self) -> bool:
        return self.flags is None or "global" in self.flags

    def compiled(self, text: str, settings: Settings, multi: bool = False) -> Pattern:
        flags = frozenset(self.flags or ()) - {"global"} | ({"dot_all", "multiline"} if multi else set())
        return Pattern(text, flags, settings.fixed_strings)

    def backtracking(self, settings: Settings) -> bool:
        return settings.pcre_mode or "pcre" in (self.flags or ())


@dataclass(frozen=True)
class Counter:
    name: str
    pattern: str
    deduplicate: bool = False
    description: str | None = None
    flags: tuple[str, ...] = ()
    collect_values: bool = False
    max_collected_values: int = 1000


@dataclass(frozen=True)
class Finalize:
    template: str | None = None
    shell: str | None = None
    counters: tuple[Counter, ...] = ()
    suppress_output: bool = False
    output_format: str = "text"


@dataclass(frozen=True)
class Pipeline:
    name: str = ""
    description: str | None = None
    version: str | None = None
    settings: Settings = field(default_factory=Settings)
    steps: tuple[Step, ...] = ()
    patterns_include: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    tests: tuple[dict, ...] = ()
    finalize: Finalize | None = None
    bidirectional: dict | None = None
    checkpoint: dict | None = None
    cross_file: Any = None

    @property
    def active(self) -> list[tuple[int, Step]]:
        return [(i, s) for i, s in enumerate(self.steps) if s.enabled]


def _tuple(v: Any) -> tuple:
    return () if v is None else (v,) if isinstance(v, str) else tuple(v)


def _alternation(v: Any) -> str:
    if isinstance(v, str):
        return v
    v = list(v)
    return "" if not v else v[0] if len(v) == 1 else "|".join(f"(?:{x})" for x in v)


def step_of(raw: dict, kind: str | None = None) -> Step:
    d = dict(raw)
    kind = d.pop("type", None) or kind or "substitute"
    if "until" in d:  # an older spelling
        d.setdefault("end_pattern", d.pop("until"))
    if "block_action" in d:
        d.setdefault("action", d.pop("block_action"))
    for key, action in (("drop", "drop_line"), ("keep", "keep_line")):
        if key in d:
            v = d.pop(key)
            if not isinstance(v, bool):
                d.setdefault("pattern", _alternation(v))
                d.setdefault("action", action)
    t = d.get("transform")
    if isinstance(t, str):
        d["transform"] = {"type": t}
    elif isinstance(t, dict) and "type" not in t and len(t) == 1:
        (k, v), = t.items()
        d["transform"] = {"type": k, **(v if isinstance(v, dict) else {})}
    if kind == "transform" and "transform" not in d and isinstance(d.get("action"), str):
        d["transform"] = {"type": d.pop("action")}
    if d.pop("ignore_case", False):
        d["flags"] = [*(d.get("flags") or []), "case_insensitive"]
    if "language" in d:
        d["languages"] = [*_tuple(d.pop("language")), *_tuple(d.get("languages"))]
    names = {f.name for f in fields(Step)}
    d = {k: v for k, v in d.items() if k in names}
    for k in ("flags", "languages", "scope", "exclude_scopes", "capture_names"):
        if k in d and d[k] is not None:
            d[k] = _tuple(d[k])
    return Step(type=kind, **d)


def _settings(raw: dict) -> Settings:
    return Settings(**{f.name: raw[f.name] for f in fields(Settings) if f.name in raw})


def _finalize(raw: dict | None) -> Finalize | None:
    if raw is None:
        return None
    counters = tuple(Counter(**({f.name: c[f.name] for f in fields(Counter) if f.name in c} | ({"flags": _tuple(c["flags"])} if "flags" in c else {}))) for c in raw.get("counters", []))
    return Finalize(raw.get("template"), raw.get("shell"), counters, raw.get("suppress_output", False), raw.get("output_format", "text"))


def from_dict(raw: dict, folder: str = ".", seen: tuple[str, ...] = ()) -> Pipeline:
    """Shorthand sections follow the ``step`` list in the order of TYPES; what ``extends`` names comes first."""
    steps = [step_of(s) for s in raw.get("step", raw.get("steps", []))]
    for kind in TYPES:
        steps += [step_of(s, kind) for s in raw.get(kind, []) if isinstance(raw.get(kind), list)]
    p = Pipeline(
        raw.get("name", ""), raw.get("description"), raw.get("version"), _settings(raw.get("settings", {})), tuple(steps), _tuple(raw.get("patterns_include")), dict(raw.get("aliases", {})),
        tuple(raw.get("test", [])), _finalize(raw.get("finalize")), raw.get("bidirectional"), raw.get("checkpoint"), raw.get("cross_file", raw.get("cross_file_rule")),
    )
    if raw.get("extends"):
        p = _merged(load(os.path.join(folder, raw["extends"]), seen), p)
    library = lib.load_all(list(p.patterns_include), folder) if p.patterns_include else {}
    return replace(p, steps=tuple(replace(s, pattern=lib.resolve(s.pattern, library, p.aliases)) if "${" in s.pattern else s for s in p.steps))


def _merged(base: Pipeline, child: Pipeline) -> Pipeline:
    plain = Settings()
    settings = replace(base.settings, **{f.name: getattr(child.settings, f.name) for f in fields(Settings) if getattr(child.settings, f.name) != getattr(plain, f.name)})
    return Pipeline(
        child.name or base.name, child.description or base.description, child.version or base.version, settings, base.steps + child.steps, tuple(dict.fromkeys(base.patterns_include + child.patterns_include)),
        base.aliases | child.aliases, child.tests or base.tests, child.finalize or base.finalize, child.bidirectional or base.bidirectional, child.checkpoint or base.checkpoint, child.cross_file or base.cross_file,
    )


def load(path: str, seen: tuple[str, ...] = ()) -> Pipeline:
    real = os.path.realpath(path)
    if real in seen:
        raise SpecError("definitions extend each other: " + " -> ".join([*seen, real]))
    with open(path, "rb") as f:
        raw = json.load(f) if path.endswith(".json") else tomllib.load(f)
    return from_dict(raw, os.path.dirname(real), (*seen, real))


def loads(text: str, folder: str = ".") -> Pipeline:
    return from_dict(json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text), folder)


def inline(pattern: str, replacement: str | None = None, extract: bool = False, transform: str | None = None, **settings: Any) -> Pipeline:
    """The pipeline of a lone pattern: a filter, or with a replacement, extraction or transform the step for that."""
    if transform:
        s = Step("transform", pattern, transform={"type": transform})
    elif extract:
        s = Step("extract", pattern, replacement=replacement)
    elif replacement is not None:
        s = Step("substitute", pattern, replacement=replacement)
    else:
        s = Step("filter", pattern, action="keep_match")
    return Pipeline("inline", settings=Settings(**settings), steps=(s,))


def to_dict(p: Pipeline) -> dict:
    """The definition as plain data that ``from_dict`` reads back."""
    plain = Step()
    steps = [{"type": s.type} | {f.name: list(v) if isinstance(v := getattr(s, f.name), tuple) else v for f in fields(Step) if f.name != "type" and getattr(s, f.name) != getattr(plain, f.name)} for s in p.steps]
    out: dict[str, Any] = {"name": p.name, "settings": {f.name: getattr(p.settings, f.name) for f in fields(Settings) if getattr(p.settings, f.name) != getattr(Settings(), f.name)}, "step": steps}
    if p.finalize:
        out["finalize"] = {f.name: getattr(p.finalize, f.name) for f in fields(Finalize) if f.name != "counters"} | {"counters": [{f.name: getattr(c, f.name) for f in fields(Counter)} for c in p.finalize.counters]}
    for k in ("description", "version", "aliases", "bidirectional", "checkpoint"):
        if getattr(p, k):
            out[k] = getattr(p, k)
    if p.tests:
        out["test"] = list(p.tests)
    return out


def to_toml(p: Pipeline) -> str:
    """The definition as TOML that ``loads`` reads back."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list | tuple):
            return "[" + ", ".join(map(value, v)) + "]"
        if isinstance(v, dict):
            return "{" + ", ".join(f"{json.dumps(k)} = {value(x)}" for k, x in v.items() if x is not None) + "}"
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")

    d = to_dict(p)
    lists = {k: d.pop(k) for k in ("step", "test") if k in d}
    out = [f"{k} = {value(v)}" for k, v in d.items() if v not in (None, {}, "")]
    for name, rows in lists.items():
        for row in rows:
            out += ["", f"[[{name}]]", *[f"{k} = {value(v)}" for k, v in row.items() if v is not None]]
    return "\n".join(out) + "\n"


# --- checks ----------------------------------------------------------------------------------------------------------


def problems(p: Pipeline) -> list[str]:
    """What makes a definition unusable."""
    out = [] if p.steps else ["no steps"]
    seen: dict[str, set[str]] = {}
    for i, s in enumerate(p.steps):
        where = f"step {i}"
        if s.type not in TYPES:
            out.append(f"{where}: unknown type {s.type!r}")
        if not (s.start_pattern or s.pattern):
            out.append(f"{where}: empty pattern")
        if s.type == "substitute" and s.replacement is None:
            out.append(f"{where}: substitute without replacement")
        if s.type == "filter" and s.action is None:
            out.append(f"{where}: filter without action")
        if s.type == "transform" and s.transform is None:
            out.append(f"{where}: transform without action")
        if s.type == "transform" and s.transform is not None and not known_transform(s.transform):
            out.append(f"{where}: no transform or plugin {s.transform.get('name', s.transform.get('type'))!r}")
        if p.settings.strict_mode and s.backtracking(p.settings) and (why := risky(s.pattern)):
            out.append(f"{where}: {why[0]}, which strict_mode forbids")
        if len(s.pattern.encode()) > p.settings.regex_size_limit:
            out.append(f"{where}: pattern longer than regex_size_limit")
        if s.type == "block" and (s.mode or p.settings.mode) != "line":
            out.append(f"{where}: block steps are line by line")
        if lib.REFERENCE.search(s.pattern) and not set(lib.REFERENCE.findall(s.pattern)) <= lib.RESERVED:
            out.append(f"{where}: unresolved reference")
        if s.flags and set(s.flags) - {"global", "case_insensitive", "multiline", "dot_all", "unicode", "extended", "pcre"}:
            out.append(f"{where}: unknown flags {sorted(s.flags)}")
        if s.enabled and s.type == "filter" and isinstance(s.action, str):
            seen.setdefault(s.pattern, set()).add("keep" if s.action.startswith("keep") else "drop" if s.action.startswith("drop") else "other")
    other = any((s.mode or p.settings.mode) != "line" or s.scope or s.exclude_scopes for s in p.steps if s.enabled)
    if other and p.settings.max_line_length and p.settings.max_line_action not in ("truncate", "error"):
        out.append("max_line_action skip passes lines by all steps, which steps on whole texts don't allow; use truncate or error")
    return out + [f"contradictory filters on {k!r}" for k, v in seen.items() if {"keep", "drop"} <= v]


def risky(pattern: str) -> list[str]:
    """Why a pattern may take exponential time in a backtracking engine."""
    out = []
    if len(pattern) > 1000:
        out.append("longer than 1000 characters")
    if re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern):
        out.append("nested quantifiers")
    if len(re.findall(r"(?<!\\)[+*?]", pattern)) > 5 and pattern.count("|") > 3:
        out.append("many quantifiers and alternatives")
    if any(int(n) > 10_000 for n in re.findall(r"\{(\d+)", pattern)):
        out.append("a repetition of more than 10000")
    return out


def complexity(pattern: str) -> int:
    """0 (plain) to 100, by length, depth, quantifiers, classes and alternatives."""
    depth = most = 0
    for c in re.sub(r"\\.", "", pattern):
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    score = min(len(pattern) // 10, 20) + 5 * most + 3 * len(re.findall(r"(?<!\\)[+*?{]", pattern)) + 2 * pattern.count("|") + 5 * pattern.count("\\p") + 15 * pattern.count(".*.*")
    return min(score, 100)


def is_literal(pattern: str) -> bool:
    return not re.search(r"[\\^$.|?*+()\[\]{}]", pattern)


def zero_width(pattern: str) -> bool:
    return Pattern(pattern).nullable


def lint(p: Pipeline) -> list[str]:
    out = []
    for i, s in enumerate(p.steps):
        out += [f"step {i}: {r}" for r in risky(s.pattern)]
        if s.pattern and is_literal(s.pattern) and not p.settings.fixed_strings:
            out.append(f"step {i}: a plain string, fixed_strings would do")
        elif s.pattern and zero_width(s.pattern):
            out.append(f"step {i}: can match nothing")
        if s.replacement and (m := re.search(r"\$(\d+[A-Za-z_]\w*)", s.replacement)) and not s.backtracking(p.settings):
            out.append(f"step {i}: ${m[1]} names a group; write ${{{re.match(r'[0-9]+', m[1])[0]}}}")
    if p.settings.timeout_ms:
        out.append("settings.timeout_ms has no effect; shell commands end after shell_timeout_secs")
    return out


def explain(p: Pipeline) -> list[str]:
    return [f"{i}. {s.type}" + (f" {s.description or s.name}" if s.description or s.name else "") + f": {s.start_pattern or s.pattern!r}" + (f" -> {s.replacement!r}" if s.replacement is not None else "") + (f" [{s.action}]" if s.action else "") + ("" if s.enabled else " (off)") for i, s in enumerate(p.steps)]


def diff(a: Pipeline, b: Pipeline) -> list[str]:
    """How two definitions differ, step by step, in settings and in included libraries."""
    out = [f"settings.{f.name}: {x!r} -> {y!r}" for f in fields(Settings) if (x := getattr(a.settings, f.name)) != (y := getattr(b.settings, f.name))]
    for i in range(max(len(a.steps), len(b.steps))):
        if i >= len(a.steps):
            out.append(f"+ step {i}: {b.steps[i].type} {b.steps[i].pattern!r}")
        elif i >= len(b.steps):
            out.append(f"- step {i}: {a.steps[i].type} {a.steps[i].pattern!r}")
        else:
            out += [f"step {i}.{f.name}: {x!r} -> {y!r}" for f in fields(Step) if (x := getattr(a.steps[i], f.name)) != (y := getattr(b.steps[i], f.name))]
    out += [f"- include {x}" for x in a.patterns_include if x not in b.patterns_include]
    return out + [f"+ include {x}" for x in b.patterns_include if x not in a.patterns_include]


# What the presets keep, and their other names.
PRESETS = {
    "cargo": [r"^error", r"^warning:", r"^\s+-->", r"^\s+\|", r"^\s+=", r"^\s+\d+\s*\|"],
    "pytest": [r"FAILED", r"ERROR", r"^E\s+", r"^>", r'^\s+File "', r"Traceback", r"AssertionError", r"^=+.*(FAILURES|ERRORS|short test summary)", r"\d+ (failed|passed|error)"],
    "npm": [r"npm ERR!", r"^Error:", r"^error:", r"npm WARN", r"^Warning:", r"^\s+at ", r"FAILED"],
    "docker": [r"^error", r"^ERROR", r"FAILED", r"failed to", r"cannot", r"unable to", r"^Step \d+/\d+", r"returned a non-zero code", r"exit code", r"exited with"],
    "logs": [r"ERROR", r"FATAL", r"CRITICAL", r"PANIC", r"WARN", r"WARNING", r"Exception", r"Traceback", r"Stack trace"],
    "git": [r"^error:", r"^fatal:", r"^CONFLICT", r"^warning:", r"^hint:", r"^\+\+\+", r"^---", r"^@@", r"^diff --git", r"^modified:", r"^deleted:", r"^new file:", r"^renamed:"],
    "ci": [r"FAILED", r"FAILURE", r"ERROR", r"Build failed", r"timeout", r"timed out", r"exceeded", r"exit code", r"exited with", r"returned \d+", r"^(Step|Stage|Job|Pipeline).*:"],
}
PRESET_ALIASES = {"rust": "cargo", "python": "pytest", "node": "npm", "log": "logs"}


def preset(name: str) -> Pipeline:
    name = PRESET_ALIASES.get(name.lower(), name.lower())
    if name not in PRESETS:
        raise SpecError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return Pipeline(name, steps=(step_of({"keep": PRESETS[name]}, "filter"),))
