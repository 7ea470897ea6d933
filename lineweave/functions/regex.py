"""Patterns of the pipeline language for the JVM's and Python's engines.

The language: Unicode-aware classes, ``.`` that leaves out the line feed only, ``$`` at the very end unless multiline, groups
``(?P<name>...)``, POSIX classes, replacement templates ``$1 ${1} $name ${name} $$`` where a missing group is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import regex as rx

FLAGS = {"global", "case_insensitive", "multiline", "dot_all", "unicode", "extended", "pcre"}
#: Java's names of POSIX classes.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "print": "Print", "graph": "Graph", "cntrl": "Cntrl", "xdigit": "XDigit", "blank": "Blank"}


class UnsupportedPattern(ValueError):
    """The pattern uses what the JVM's engine can't express."""


@dataclass(frozen=True)
class Pattern:
    source: str
    flags: frozenset[str] = frozenset()
    fixed: bool = False

    @property
    def java(self) -> str:
        return _java(self.source, self.flags, self.fixed)

    @property
    def python(self) -> rx.Pattern:
        return _python(self.source, self.flags, self.fixed)

    @property
    def groups(self) -> int:
        return self.python.groups

    @property
    def nullable(self) -> bool:
        """Whether it can match nothing at all; engines differ on empty matches, so such patterns go through Python."""
        return not self.fixed and _nullable(self.source, self.flags)

    @property
    def required(self) -> str:
        """The longest string that every match holds for sure; '' if none is plain to see. A look for it spares the engine most lines."""
        return "" if self.fixed or self.flags & {"case_insensitive", "extended"} else _required(self.source)

    @property
    def body(self) -> str:
        """The Java pattern without its leading flags."""
        j = self.java
        return j[j.index(")") + 1 :] if j.startswith("(?") and not self.fixed else j

    @property
    def prefix(self) -> str:
        j = self.java
        return j[: j.index(")") + 1] if j.startswith("(?") and not self.fixed else ""


@lru_cache(4096)
def _java(p: str, flags: frozenset[str], fixed: bool) -> str:
    if fixed:
        return "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    multi = "multiline" in flags
    head = "(?U" + "d" + ("iu" if "case_insensitive" in flags else "") + ("m" if multi else "") + ("s" if "dot_all" in flags else "") + ("x" if "extended" in flags else "") + ")"
    out, i, n, depth = [], 0, len(p), 0
    while i < n:
        c = p[i]
        if c == "\\":
            out.append(p[i : i + 2])
            i += 2
            continue
        if depth:
            if c == "[" and p[i + 1 : i + 2] == ":" and (end := p.find(":]", i)) > 0:
                name = p[i + 2 : end]
                neg = name.startswith("^")
                out.append(("\\P{" if neg else "\\p{") + POSIX[name.lstrip("^")] + "}")
                i = end + 2
                continue
            if p[i : i + 2] in ("--", "~~"):
                raise UnsupportedPattern(f"set operation {p[i : i + 2]!r} in {p!r}")
            if c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            out.append(c)
            i += 1
            continue
        if c == "[":
            depth = 1
            out.append(c)
            i += 1
            if p[i : i + 1] == "^":
                out.append("^")
                i += 1
            if p[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "$" and not multi:
            out.append("\\z")
        elif p.startswith("(?P<", i) or p.startswith("(?<", i) and p[i + 3 : i + 4] not in ("=", "!"):
            end = p.index(">", i)
            name = p[p.index("<", i) + 1 : end]
            out.append(f"(?<{mangled(name)}>")
            i = end + 1
            continue
        elif p.startswith("(?", i) and (m := rx.match(r"\(\?([a-zA-Z-]+)[:)]", p, pos=i)) and "U" in m[1]:
            raise UnsupportedPattern(f"swapped greed in {p!r}")
        else:
            out.append(c)
        i += 1
    return head + "".join(out)


@lru_cache(4096)
def _required(p: str) -> str:
    if rx.search(r"\(\?[a-zA-Z-]+[:)]", p):
        return ""
    runs, cur, i = [], "", 0
    while i < len(p):
        c = p[i]
        if c == "|":
            return ""
        if c == "\\" and i + 1 < len(p) and not p[i + 1].isalnum():
            cur += p[i + 1]
            i += 2
            continue
        if c in "*?{":
            runs.append(cur[:-1])
            cur = ""
            i = p.index("}", i) + 1 if c == "{" and "}" in p[i:] else i + 1
            continue
        if c in "\\[(.^$+":
            runs.append(cur)
            cur = ""
            if c == "\\":
                if p[i + 1 : i + 2] in tuple("xuUcQkN0123456789"):  # characters by number or name, quoted text, back-references
                    return ""
                i = p.index("}", i) + 1 if p[i + 1 : i + 3] in ("p{", "P{") and "}" in p[i:] else i + 2
            elif c in "[(":
                i = _closed(p, i)
            else:
                i += 1
            continue
        cur += c
        i += 1
    return max([*runs, cur], key=len)


def _closed(p: str, i: int) -> int:
    """Where the class or group that opens at i has ended."""
    depth, inside = 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside += (c == "[") - (c == "]")
        elif c == "[":
            inside = 1
            if p[i + 1 : i + 2] == "^":
                i += 1
            if p[i + 1 : i + 2] == "]":
                i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        i += 1
        if not inside and not depth:
            break
    return i


def mangled(name: str) -> str:
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"X{ord(c):x}" for c in name)


@lru_cache(4096)
def _python(p: str, flags: frozenset[str], fixed: bool) -> rx.Pattern:
    if fixed:
        return rx.compile(rx.escape(p))
    f = rx.V1
    for name, flag in (("case_insensitive", rx.IGNORECASE), ("multiline", rx.MULTILINE), ("dot_all", rx.DOTALL), ("extended", rx.VERBOSE)):
        if name in flags:
            f |= flag
    out, i, depth = [], 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            out.append("\\Z" if p[i : i + 2] == "\\z" else p[i : i + 2])
            i += 2
            continue
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        out.append("\\Z" if c == "$" and not depth and "multiline" not in flags else c)
        i += 1
    return rx.compile("".join(out), f)


@lru_cache(4096)
def _nullable(p: str, flags: frozenset[str]) -> bool:
    c = _python(p, flags, False)
    return any((m := c.search(s)) is not None and m.end() == m.start() for s in ("", "a", "0 ", "-"))


# --- replacement templates -------------------------------------------------------------------------------------------

Token = str | int
_REF = rx.compile(r"\$(?:(\$)|\{([^}]*)\}|([0-9A-Za-z_]+))")


def template(text: str, pattern: Pattern, backtracking: bool = False) -> list[Token]:
    """The template as literal strings and group numbers. With ``backtracking`` only ``$0`` to ``$9`` refer to groups, and
    ``$1x`` is group 1 and ``x``; otherwise ``$1x`` is a group named ``1x``, which there is none of."""
    names = pattern.python.groupindex
    out: list[Token] = []
    at = 0
    rule = rx.compile(r"\$(?:(\$)|\{(\d)\}|(\d))") if backtracking else _REF
    for m in rule.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            out.append("$")
            continue
        name = m[2] if m[2] is not None else m[3]
        k = int(name) if name.isascii() and name.isdigit() else names.get(name, -1)
        if 0 <= k <= pattern.groups:
            out.append(k)
    out.append(text[at:])
    merged: list[Token] = []
    for t in out:
        if t == "":
            continue
        if merged and isinstance(t, str) and isinstance(merged[-1], str):
            merged[-1] += t
        else:
            merged.append(t)
    return merged


def java_template(tokens: list[Token], shift: int = 0) -> str:
    out = []
    for k, t in enumerate(tokens):
        if isinstance(t, int):
            out.append(f"${t + shift}")
        else:
            s = t.replace("\\", "\\\\").replace("$", "\\$")
            if k and isinstance(tokens[k - 1], int) and s[:1].isdigit():
                s = "\\" + s
            out.append(s)
    return "".join(out)


def expand(tokens: list[Token], m: rx.Match) -> str:
    return "".join(t if isinstance(t, str) else (m[t] or "") for t in tokens)


def matches(pattern: Pattern, text: str) -> list[rx.Match]:
    """All matches from left to right; an empty match right where the last one ended doesn't count."""
    out, end = [], -1
    for m in pattern.python.finditer(text):
        if m.start() == m.end() == end:
            continue
        out.append(m)
        end = m.end()
    return out


def substitute(pattern: Pattern, text: str, make, every: bool = True) -> tuple[str, int]:  # noqa: ANN001
    """The text with each match (or the first) replaced by ``make(match)``, and how many there were."""
    found = matches(pattern, text)
    if not every:
        found = found[:1]
    out, at = [], 0
    for m in found:
        out += [text[at : m.start()], make(m)]
        at = m.end()
    return "".join(out) + text[at:], len(found)


def has_backreference(p: str) -> bool:
    return bool(rx.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)|\(\?P=", p))
