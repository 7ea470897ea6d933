"""What opens a log record: header layouts, level words, and the templates that frequent words form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

from .timestamps import match_timestamp

# Level words and letters by the level they mean.
LEVELS = {
    word: level
    for level, words in {
        "TRACE": "trace trc verbose finest finer t v",
        "DEBUG": "debug dbg fine d",
        "INFO": "info inf information informational notice note config i n",
        "WARN": "warn warning wrn w",
        "ERROR": "error err severe failure e s",
        "FATAL": "fatal critical crit emergency emerg alert panic f c a p",
    }.items()
    for word in words.split()
}
# Numeric levels of JSON loggers, and syslog severities 0 to 7.
JSON_LEVELS = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
# Names under which structured records hold their time, level and component.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t", "datetime", "date", "asctime", "eventtime")
LEVEL_KEYS = ("level", "lvl", "severity", "log.level", "loglevel", "levelname", "log_level", "sev")
NAME_KEYS = ("component", "logger", "svc", "service", "name", "module", "log.logger", "logger_name", "source", "subsystem", "category")
MESSAGE_KEYS = ("msg", "message", "text", "event", "body")

#: What a line is: no part of a header, the start of a record, a bare brace that may start one, a member line with a
#: field of one, another brace, the last line seen of a file.
NONE, START, BRACE, MEMBER, OTHER_BRACE, EXTENT = range(6)

_WORDS = sorted((w for w in LEVELS if len(w) > 1), key=len, reverse=True)
_LV = rf"(?:(?i:{'|'.join(_WORDS)})|[TDINWEFCV])(?![\w])"
_C = r"[^\W\d][\w.$/-]*(?<![.])"
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_SYSLOG_5424 = re.compile(rf" \S+ (?P<c>{_C}|-) \S+ \S+ (?:-|\[(?:[^\]\\]|\\.)*\])+ ?")
_SYSLOG_3164 = re.compile(rf" \S+ (?P<c>{_C})(?:\[\d+\])?: ?")
_PRI = re.compile(r"<(\d{1,3})>(?:\d )?")
_GLOG = re.compile(r"(?P<l>[TDIWEFC])(?P<m>\d\d)(?P<d>\d\d) (?P<t>\d\d:\d\d:\d\d(?:\.\d{1,9})?)\s+\d+ (?P<c>[\w./-]+?)(?:\.[A-Za-z]\w*)?:\d+\] ?")
_LEVEL_FIRST = re.compile(rf"\[?(?P<l>{_LV})\]?(?::(?P<c1>{_C}):| +(?P<c2>{_C}): ?)")
_ACCESS = re.compile(r"[\da-fA-F.:]{3,45} \S+ .{1,200}? ?\[(?=\d\d/)")
_LOGFMT = re.compile(r"(?:ts|time|timestamp|t|level|lvl|severity)=")
_PAIRS = re.compile(r'([\w.@]+)=("(?:[^"\\]|\\.)*"|\S*)')
_MEMBER = re.compile(r'\s+"([^"\\]{1,40})"\s*:\s*("(?:[^"\\]|\\.)*"|-?[\d.]+)\s*,?\s*$')
_MEMBERS = re.compile(r'"([^"\\]{1,40})"\s*:\s*("(?:[^"\\]|\\.)*"|-?[\d.]+)')
_KEYS = {k: "t" for k in TIME_KEYS} | {k: "l" for k in LEVEL_KEYS} | {k: "c" for k in NAME_KEYS} | {k: "m" for k in MESSAGE_KEYS}

Header = tuple[int, str | None, str | None, int, int | None, int]  # what, level, component, kind of time, microseconds, start of the message
_FALSE: Header = (NONE, None, None, 0, None, 0)


def level_of(value: object) -> str:
    """The level that a word, letter or number means; '' if it means none."""
    if isinstance(value, bool):
        return ""
    if isinstance(value, int | float):
        return JSON_LEVELS.get(int(value), "")
    text = str(value).strip()
    return JSON_LEVELS.get(int(text), "") if text.isdigit() else LEVELS.get(text.lower(), "")


def _time(value: object) -> tuple[int, int | None]:
    text = str(value).strip()
    found = match_timestamp(text)
    return (found[1], found[2]) if found and found[0] == len(text) else (0, None)


def _fields(pairs: Iterable[tuple[str, object]], at: int) -> Header:
    seen: dict[str, object] = {}
    for k, v in pairs:
        if (what := _KEYS.get(k.lower())) and what not in seen and not isinstance(v, dict | list):
            seen[what] = v
    if "t" not in seen and "l" not in seen:
        return _FALSE
    kind, us = _time(seen["t"]) if "t" in seen else (0, None)
    level = level_of(seen["l"]) if "l" in seen and seen["l"] is not None else ""
    if not kind and not level:
        return _FALSE
    return START, level, str(seen.get("c") or ""), kind, us, at


def _json(t: str) -> Header:
    if t == "{":
        return BRACE, None, None, 0, None, 0
    try:
        got = json.loads(t)
        pairs: Iterable = got.items() if isinstance(got, dict) else ()
    except ValueError:
        pairs = ((k, v.strip('"')) for k, v in _MEMBERS.findall(t))
    return _fields(pairs, 0)


def _syslog(t: str) -> Header:
    if not (m := _PRI.match(t)) or int(m[1]) > 191 or not (ts := match_timestamp(t, m.end())):
        return _FALSE
    level = SEVERITIES[int(m[1]) & 7]
    rest = _SYSLOG_5424.match(t, ts[0]) or _SYSLOG_3164.match(t, ts[0])
    name = rest["c"] if rest else ""
    return START, level, "" if name == "-" else name, ts[1], ts[2], rest.end() if rest else ts[0]


def _stamped(t: str) -> Header:
    at = int(t[0] == "[")
    if not (ts := match_timestamp(t, at)):
        return _FALSE
    end = ts[0]
    if at:
        if t[end : end + 1] != "]":
            return _FALSE
        end += 1
    return START, None, None, ts[1], ts[2], end


def _glog(t: str) -> Header:
    if not (m := _GLOG.match(t)):
        return _FALSE
    ts = match_timestamp(f"2000-{m['m']}-{m['d']} {m['t']}")
    return START, LEVELS[m["l"].lower()], m["c"], 3, ts[2] if ts else None, m.end()


def _logfmt(t: str) -> Header:
    if not _LOGFMT.match(t):
        return _FALSE
    return _fields(((k, v[1:-1] if v[:1] == '"' and len(v) > 1 else v) for k, v in _PAIRS.findall(t)), 0)


def _level_first(t: str) -> Header:
    if not (m := _LEVEL_FIRST.match(t)):
        return _FALSE
    kind, us = 0, None
    at = t.rfind(" @ ")
    if at >= m.end() - 1 and (ts := match_timestamp(t, at + 3)) and not t[ts[0] :].strip():
        kind, us = ts[1], ts[2]
    return START, LEVELS[m["l"].lower()], m["c1"] or m["c2"], kind, us, m.end()


def _access(t: str) -> Header:
    if not (m := _ACCESS.match(t)) or not (ts := match_timestamp(t, m.end())) or t[ts[0] : ts[0] + 1] != "]":
        return _FALSE
    return START, "", "", ts[1], ts[2], ts[0] + 1


#: The rules, in the order in which a line tries those for its first character.
RULES = (_json, _syslog, _stamped, _glog, _logfmt, _level_first, _access)


def _first_rules(c: str) -> tuple[int, ...]:
    if c == "{":
        return (0,)
    if c == "<":
        return (1,)
    if c == "[":
        return (2, 5)
    if c.isdigit():
        return (2, 6)
    if c.isalpha():
        return (3, 4, 2, 5, 6) if c.isascii() else (2,)
    if c == ":":
        return (6,)
    return (1, 2, 3, 4, 5, 6)  # all but that for JSON, which takes any line with members


def clean(text: str) -> str:
    """The line without its end, byte order mark and colour codes."""
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    return text.lstrip("\ufeff").rstrip("\r\n")


#: So many tokens behind the time are looked at for level and component.
HEAD = 5
_TOKEN = re.compile(r"\[[^\]]*\][^\s|]*|\||[^\s|]+")
_NAME = re.compile(rf"({_C})(?:\[\d+\])?:?")
_ROUND = "[](){}<>:,; "


def head_of(t: str, at: int) -> list[str]:
    """The first tokens from ``at`` on; bars and what stands in brackets are tokens of their own."""
    out = []
    for m in _TOKEN.finditer(t, at):
        out.append(m[0])
        if len(out) == HEAD:
            break
    return out


def _is_level(bare: str) -> bool:
    return bare.lower() in LEVELS and (len(bare) > 1 or bare in "TDINWEFCV")


#: The forms a token has in a template's skeleton: separators, level words (L), names (N) and other tokens, with what stands around them.
FORMS = ("|", "-", "[L]", "L:", "L", "N.L:", "N:", "[*]", "N", "*")


@lru_cache(1 << 17)
def form_of(token: str) -> str:
    if token in ("|", "-"):
        return token
    if _is_level(token.strip(_ROUND)):
        return "[L]" if token[0] == "[" else "L:" if token[-1] == ":" else "L"
    if token[-1] == ":":
        name, _, last = token[:-1].rpartition(".")
        if name and _is_level(last) and re.fullmatch(_C, name):
            return "N.L:"
        return "N:" if _NAME.fullmatch(token) else "*"
    return "[*]" if token[0] == "[" else "N" if _NAME.fullmatch(token) else "*"


def skeleton_of(head: list[str]) -> str:
    """The forms of a head's tokens up to where its message begins: behind a name with a colon, a level behind a name, a name
    behind a level, or at the first token that is no name; a separator there belongs to the head."""
    out: list[str] = []
    for f in map(form_of, head):
        if out and (out[-1] in ("N:", "N.L:", "L:") or (out[-1] in ("L", "[L]") and "N" in out or out[-1] == "N" and ("L" in out or "[L]" in out)) and f not in ("|", "-") or out[-1] == "*"):
            break
        if out and out[-1] in ("|", "-") and len(out) > 1 and (out[-2] in ("L", "[L]") and "N" in out or out[-2] == "N" and ("L" in out or "[L]" in out)):
            break
        out.append(f)
    return " ".join(out)


def slots_of(skeleton: str, constant: list[float], least: float = 0.2) -> tuple[int, int]:
    """Which tokens of a template's lines are the level and the component (-1: none).

    constant: for each token the share of the skeleton's lines in which it is a frequent word. A name counts only where it is
    a constant in ``least`` of the lines; behind a name with a colon the message begins.
    """
    forms = skeleton.split(" ")
    named = lambda k: k if constant[k] >= least else -1
    for i, f in enumerate(forms):
        if f == "N.L:":
            return i, i
        if "L" in f:
            before = [j for j in range(i) if forms[j] == "N"]
            if before:  # a level word behind text that is no constant is part of a message
                return (i, before[-1]) if named(before[-1]) >= 0 else (-1, -1)
            k = i + 1
            while f != "L:" and k < len(forms) and forms[k] in ("-", "|", "[*]"):
                k += 1
            if f != "L:" and k < len(forms) and (forms[k] == "N:" or forms[k] == "N" and forms[k + 1 : k + 2] in (["-"], ["|"])):
                return i, named(k)
            return i, -1
        if f == "N:":
            return -1, named(i)
    return -1, -1


def by_rules(head: list[str]) -> tuple[str, str]:
    """(level, component) of a head that belongs to no template: its first level word, and a name with a colon."""
    level = name = ""
    for token in head:
        f = form_of(token)
        if f == "N.L:":
            name, _, level = token[:-1].rpartition(".")
            return LEVELS[level.lower()], name
        if "L" in f:
            level = level or LEVELS[token.strip(_ROUND).lower()]
        elif f == "N:":
            return level, _NAME.fullmatch(token)[1]
        if f in ("*", "L:"):
            break
    return level, ""


class HeaderParser:
    """Parses lines one by one.

    Records that name or number their fields (JSON, logfmt, syslog priorities and the like) are read by rules. Of a line that
    begins with a time, ``parse`` gives only the time, and where its head begins: what the head's tokens are is decided by
    the template the line belongs to (``log_entries``); ``parse_alone`` decides by the fallback rules.
    """

    def parse(self, text: str) -> Header:
        t = clean(text)
        if not t:
            return _FALSE
        c = t[0]
        if c.isspace():
            if (m := _MEMBER.match(t)) and (what := _KEYS.get(m[1].lower())) and what != "m":
                v = m[2][1:-1] if m[2][0] == '"' else m[2]
                kind, us = _time(v) if what == "t" else (0, None)
                number = int(v) if what == "l" and m[2].isdigit() else v
                return MEMBER, level_of(number) if what == "l" else None, v if what == "c" else None, kind, us, 0
            return (OTHER_BRACE, None, None, 0, None, 0) if t.endswith("{") or t.strip() in ("}", "},") else _FALSE
        if c == "}" or t.endswith("{") and t != "{":
            return OTHER_BRACE, None, None, 0, None, 0
        for i in _first_rules(c):
            if (got := RULES[i](t))[0]:
                return got
        return _FALSE

    def parse_alone(self, text: str) -> Header:
        got = self.parse(text)
        if got[0] != START or got[1] is not None:
            return got
        return got[0], *by_rules(head_of(clean(text), got[5])), *got[3:]


def _message_start(t: str, at: int, level: str, component: str) -> int:
    """Where the message of a line begins whose head holds a level and a component."""
    tokens, last = [], -1
    for m in _TOKEN.finditer(t, at):
        tokens.append(m)
        if len(tokens) == HEAD + 1:
            break
    for i, m in enumerate(tokens[:HEAD]):
        form, name = form_of(m[0]), _NAME.fullmatch(m[0])
        if component and (name and name[1] == component or form == "N.L:" and m[0].startswith(component + ".")) or level and form in ("[L]", "L:", "L") and last < 0:
            last = i
            if form in ("N:", "N.L:"):
                break
    while 0 <= last and last + 1 < len(tokens) and tokens[last + 1][0] in ("-", "|"):
        last += 1
    return tokens[last].end() if last >= 0 else at


def message_of(lines: list[str], level: str | None = None, component: str | None = None) -> str:
    """The message of an entry's lines: what follows the header, or the message field of a structured record, and the lines after it."""
    if not lines:
        return ""
    lines = [clean(x) for x in lines]
    t, rest = lines[0], lines[1:]
    if t == "{":
        end = lines.index("}") if "}" in lines else len(lines) - 1
        pairs = [(k, v) for k, v in _MEMBERS.findall("\n".join(lines[: end + 1]))]
        head, rest = _message([(k, v[1:-1] if v[0] == '"' else v) for k, v in pairs]), lines[end + 1 :]
    elif t.startswith("{"):
        try:
            got = json.loads(t)
            head = _message(list(got.items())) if isinstance(got, dict) else t
        except ValueError:
            head = _message([(k, v.strip('"')) for k, v in _MEMBERS.findall(t)])
    elif _LOGFMT.match(t):
        head = _message([(k, v[1:-1].replace('\\"', '"') if v[:1] == '"' and len(v) > 1 else v) for k, v in _PAIRS.findall(t)])
    else:
        got = HeaderParser().parse(t)
        if level is None and got[0] == START and got[1] is None:
            level, component = by_rules(head_of(t, got[5]))
        head = t[_message_start(t, got[5], level, component) if got[1] is None and got[0] == START else got[5] :].strip()
        at = head.rfind(" @ ")
        if at >= 0 and (ts := match_timestamp(head, at + 3)) and ts[0] == len(head):
            head = head[:at]
        if t[:1] == "[" and head.endswith(" []"):
            head = head[:-3]
    return "\n".join([head, *rest])


def _message(pairs: list[tuple[str, object]]) -> str:
    for k in MESSAGE_KEYS:
        for name, v in pairs:
            if name.lower() == k:
                return str(v)
    return ""
