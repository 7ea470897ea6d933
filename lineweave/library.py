"""Named patterns: built-in ones, libraries in TOML that include each other, and references to them."""

from __future__ import annotations

import os
import re
import tomllib

# The built-in patterns.
BUILTIN = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "ipv6": r"\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "phone_us": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "date_iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "date_us": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "time_24h": r"\b\d{1,2}:\d{2}(:\d{2})?\b",
    "datetime_iso": r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "hex_id": r"\b[0-9a-fA-F]{8,}\b",
    "url": r"""https?://[^\s<>"']+""",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "api_key": r"\b[A-Za-z0-9_-]{20,}\b",
    "base64": r"\b[A-Za-z0-9+/]{20,}={0,2}\b",
    "log_level": r"\b(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b",
    "timestamp_syslog": r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    "json_object": r"\{[^{}]*\}",
    "semver": r"\b\d+\.\d+\.\d+(-[a-zA-Z0-9.]+)?(\+[a-zA-Z0-9.]+)?\b",
}
REFERENCE = re.compile(r"\$\{([a-zA-Z_][a-zA-Z0-9_.:]*)\}")
RESERVED = {"seq", "count"}
DEEPEST = 32


class LibraryError(ValueError):
    pass


def _flat(tree: dict, at: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in tree.items():
        name = f"{at}.{k}" if at else k
        if isinstance(v, dict):
            out |= _flat(v, name)
        elif isinstance(v, str):
            out[name] = v
    return out


def find(name: str, folders: list[str]) -> str:
    """The file that an include names: as given, or with ``.toml``, in the first folder that has it."""
    for folder in ["", *folders]:
        for end in ("", ".toml"):
            path = os.path.join(folder, name + end)
            if os.path.isfile(path):
                return path
    raise LibraryError(f"library {name!r} not found in {folders}")


def load(path: str, seen: tuple[str, ...] = ()) -> dict[str, str]:
    """name -> pattern of a library file and what it includes; its own definitions come before included ones."""
    real = os.path.realpath(path)
    if real in seen:
        raise LibraryError("libraries include each other: " + " -> ".join([*seen, real]))
    if len(seen) >= DEEPEST:
        raise LibraryError(f"libraries are nested more than {DEEPEST} deep")
    with open(path, "rb") as f:
        tree = tomllib.load(f)
    out = _flat(tree.get("patterns", {}))
    for name in tree.get("patterns_include", []):
        for k, v in load(find(name, [os.path.dirname(real)]), (*seen, real)).items():
            out.setdefault(k, v)
    return out


def load_all(names: list[str], folder: str) -> dict[str, str]:
    folders = [folder, os.getcwd(), os.path.expanduser("~/.lineweave/patterns")]
    out: dict[str, str] = {}
    for n in names:
        for k, v in load(find(n, folders)).items():
            out.setdefault(k, v)
    return out


def resolve(pattern: str, library: dict[str, str], aliases: dict[str, str] | None = None) -> str:
    """The pattern with each ``${name}`` replaced once; unknown names raise."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in RESERVED:
            return m[0]
        if aliases and name in aliases:
            return aliases[name]
        if name.startswith("builtin:") and name[8:] in BUILTIN:
            return BUILTIN[name[8:]]
        if name in library:
            return library[name]
        raise LibraryError(f"unknown pattern {name!r}")

    return REFERENCE.sub(one, pattern)
