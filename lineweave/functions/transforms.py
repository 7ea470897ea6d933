"""Transform actions and named functions on matched text: column expressions where the JVM has them, Python for matches inside a line."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


# --- as column expressions, for patterns that take the whole line -------------------------------------------------------

def _padded(c: Column) -> Column:
    """Base64 without its padding, padded again; a lone last character stands for the upper bits of a byte."""
    return F.concat(c, F.element_at(F.array(F.lit(""), F.lit("A=="), F.lit("=="), F.lit("=")), (F.char_length(c) % 4 + 1).cast("int")))


WHOLE = {".*", "^.*$", ".+", "^.+$", "^(.*)$", "(.*)"}
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "uppercase": F.upper,
    "lowercase": F.lower,
    "trim": lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""),
    "reverse": F.reverse,
    "remove_whitespace": lambda c: F.regexp_replace(c, r"(?U)\s", ""),
    "base64_encode": lambda c: F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit("")),
    "base64_decode": lambda c: F.coalesce(F.when(c.rlike(r"\A[A-Za-z0-9+/]*=*\z"), F.try_validate_utf8(F.try_to_binary(_padded(F.regexp_replace(c, r"=+\z", "")), F.lit("base64")).cast("string"))), c),
    "normalize_whitespace": lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")),
    "deduplicate": lambda c: F.array_join(F.array_distinct(F.split(c, "\n")), "\n"),
    "sort_chars": lambda c: F.array_join(F.array_sort(F.split(c, "")), ""),
    "char_count": lambda c: F.char_length(c).cast("string"),
    "word_count": lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).cast("string"),
    "title_case": lambda c: F.initcap(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))),
    "length": lambda c: F.octet_length(c).cast("string"),
    "hex_encode": lambda c: F.lower(F.hex(c)),
    "squeeze": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
    "snake_case": lambda c: F.lower(F.regexp_replace(c, r"(?<!^)(?=\p{Lu})", "_")),
    "kebab_case": lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"(?<!^)(?=\p{Lu})", "-")), "[ _]", "-"),
}


def column(spec: dict, replacement: str | None = None) -> Callable[[Column], Column] | None:
    """The expression for a transform of whole lines, if the JVM has one."""
    kind = spec["type"]
    name, args = (spec.get("name"), [str(x) for x in spec.get("args", [])]) if kind == "plugin" else (kind, [])
    if kind == "plugin" and name in _REPLACED:
        return None
    if kind in ("prepend", "append"):
        text = F.lit(spec.get("text", replacement or ""))
        return (lambda c: F.concat(text, c)) if kind == "prepend" else (lambda c: F.concat(c, text))
    if not args and name in COLUMNS:
        return COLUMNS[name] if kind == "plugin" or name in SIMPLE or name in REGISTRY else None
    n = _arg(args, 0, -1)
    if name == "repeat":
        return lambda c: F.repeat(c, max(_arg(args, 0, 2), 0))
    if name == "slice" and n >= 0 and _arg(args, 1, n) >= n:
        return lambda c: F.substring(c, F.lit(n + 1), F.lit(_arg(args, 1, 1 << 30) - n))
    if name in ("pad_left", "pad_right") and n >= 0:
        pad, char = F.lpad if name == "pad_left" else F.rpad, args[1][:1] if len(args) > 1 and args[1] else " "
        return lambda c: F.replace(F.when(F.char_length(c) < n, pad(c, n, " ")).otherwise(c), F.lit(" "), F.lit(char))
    if name == "truncate" and n >= 0:
        return lambda c: F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(args[1] if len(args) > 1 else "..."))).otherwise(c)
    if name in ("strip_prefix", "strip_suffix") and args:
        size = len(args[0])
        cut = (lambda c: F.substring(c, F.lit(size + 1), F.char_length(c))) if name == "strip_prefix" else (lambda c: F.substring(c, F.lit(1), F.char_length(c) - size))
        return lambda c: F.when(c.startswith(args[0]) if name == "strip_prefix" else c.endswith(args[0]), cut(c)).otherwise(c)
    return None


#: Names of built-in plugins that ``register`` has given another meaning.
_REPLACED: set[str] = set()


# --- on single strings --------------------------------------------------------------------------------------------------


def title_case(s: str) -> str:
    return " ".join(w[:1].upper() + w[1:].lower() for w in s.split())


def base64_decode(s: str) -> str:
    """The text itself if it holds anything but the alphabet, or what it stands for isn't UTF-8; padding may be missing."""
    bare = s.rstrip("=")
    try:
        return base64.b64decode(bare + ("", "A==", "==", "=")[len(bare) % 4], validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return s


def url_encode(s: str) -> str:
    """By code point, as the pipeline language defines it."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_.~") else f"%{ord(c):02X}" for c in s)


def url_decode(s: str) -> str:
    """One character for each ``%XX``; as it was if any is malformed."""
    out, i = [], 0
    while i < len(s):
        if s[i] == "%":
            h = s[i + 1 : i + 3]
            if len(h) < 2 or any(x not in "0123456789abcdefABCDEF" for x in h):
                return s
            out.append(chr(int(h, 16)))
            i += 3
        else:
            out.append(" " if s[i] == "+" else s[i])
            i += 1
    return "".join(out)


def mask_deterministic(s: str, seed: str = "", mask_char: str = "*", keep_prefix: int = 0, keep_suffix: int = 0) -> str:
    """The same mask for the same seed and text: digits drawn from a 64-bit stream for ``*``, else the mask character."""
    if keep_prefix + keep_suffix >= len(s):
        return s
    h = 0xCBF29CE484222325
    for c in seed + s:
        h = ((h ^ ord(c)) * 0x100000001B3) & M64
    out = []
    for _ in range(len(s) - keep_prefix - keep_suffix):
        h ^= h >> 12
        h = (h ^ (h << 25)) & M64
        h ^= h >> 27
        out.append(str((h * 0x2545F4914F6CDD1D & M64) % 10) if mask_char == "*" else mask_char)
    return s[:keep_prefix] + "".join(out) + s[len(s) - keep_suffix :]


def _words(s: str) -> list[str]:
    return [w for w in s.replace("_", " ").replace("-", " ").split(" ") if w]


def _int(s: str, f: Callable[[int], int | str]) -> str:
    try:
        return str(f(int(s.strip())))
    except ValueError:
        return s


def _pad(s: str, width: int, char: str, left: bool) -> str:
    return (s.rjust(width) if left else s.ljust(width)).replace(" ", char)


def char_freq(s: str) -> str:
    """The five most frequent characters; ties in the order of their code points."""
    return ",".join(f"{c}:{s.count(c)}" for c in sorted(set(s), key=lambda c: (-s.count(c), c))[:5])


def hex_decode(s: str) -> str:
    pairs = [s[i : i + 2] for i in range(0, len(s) - 1, 2)]
    return bytes(int(p, 16) for p in pairs if all(c in "0123456789abcdefABCDEF" for c in p)).decode("utf-8", "replace")


# The twelve tones with sharps and with flats.
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]


def transpose(s: str, semitones: int = 0) -> str:
    """A chord moved by semitones; its root is spelled with a flat if it was."""
    root = s[:2] if s[1:2] in ("#", "b") else s[:1]
    scale = FLATS if root.endswith("b") and len(root) == 2 else SHARPS
    at = next((t.index(root) for t in (SHARPS, FLATS) if root in t), None)
    return s if at is None else scale[(at + semitones) % 12] + s[len(root) :]


def _arg(a: list[str], k: int, default: int) -> int:
    try:
        return int(a[k])
    except (IndexError, ValueError):
        return default


def _now() -> str:
    import time

    return str(int(time.time()))


#: name -> f(text, args); ``register`` adds to it and may replace what is here.
REGISTRY: dict[str, Callable[[str, list[str]], str]] = {
    "reverse": lambda s, a: s[::-1],
    "repeat": lambda s, a: s * _arg(a, 0, 2),
    "slice": lambda s, a: s[_arg(a, 0, 0) : _arg(a, 1, len(s))],
    "pad_left": lambda s, a: _pad(s, _arg(a, 0, 10), a[1][:1] if len(a) > 1 and a[1] else " ", True),
    "pad_right": lambda s, a: _pad(s, _arg(a, 0, 10), a[1][:1] if len(a) > 1 and a[1] else " ", False),
    "truncate": lambda s, a: s if len(s) <= _arg(a, 0, 10) else s[: _arg(a, 0, 10)] + (a[1] if len(a) > 1 else "..."),
    "snake_case": lambda s, a: "".join(("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(s)),
    "kebab_case": lambda s, a: "".join(("-" if i and c.isupper() else "") + c.lower() for i, c in enumerate(s)).replace(" ", "-").replace("_", "-"),
    "camel_case": lambda s, a: "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(_words(s))),
    "pascal_case": lambda s, a: "".join(w[:1].upper() + w[1:].lower() for w in _words(s)),
    "length": lambda s, a: str(len(s.encode())),
    "word_count": lambda s, a: str(len(s.split())),
    "line_count": lambda s, a: str(len(s.removesuffix("\n").split("\n")) if s else 0),
    "char_freq": lambda s, a: char_freq(s),
    "hex_encode": lambda s, a: s.encode().hex(),
    "hex_decode": lambda s, a: hex_decode(s),
    "squeeze": lambda s, a: "".join(" " if c.isspace() else c for i, c in enumerate(s) if not (c.isspace() and i and s[i - 1].isspace())),
    "strip_prefix": lambda s, a: s.removeprefix(a[0]) if a else s,
    "strip_suffix": lambda s, a: s.removesuffix(a[0]) if a else s,
    "increment": lambda s, a: _int(s, lambda x: x + _arg(a, 0, 1)),
    "decrement": lambda s, a: _int(s, lambda x: x - _arg(a, 0, 1)),
    "format_number": lambda s, a: _int(s, lambda x: f"{x:,}"),
    "timestamp": lambda s, a: _now(),
    "transpose": lambda s, a: transpose(s, _arg(a, 0, 0)),
}


def register(name: str, function: Callable[[str, list[str]], str]) -> None:
    REGISTRY[name] = function
    _REPLACED.add(name)


def script(path: str, timeout: float = 30.0) -> Callable[[str, list[str]], str]:
    """A function that runs a script with the text on its input; the text stays as it is if the script fails."""
    import subprocess

    by = {".sh": ["sh"], ".py": ["python3"], ".rb": ["ruby"], ".pl": ["perl"]}.get(path[path.rfind(".") :], [])

    def run(s: str, args: list[str]) -> str:
        try:
            done = subprocess.run([*by, path, *args], input=s, capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.SubprocessError):
            return s
        return done.stdout.rstrip() if done.returncode == 0 else s

    return run


def shell(command: str, timeout: float = 30.0) -> Callable[[str], str]:
    import subprocess

    def run(s: str) -> str:
        try:
            done = subprocess.run(["sh", "-c", command], input=s, capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.SubprocessError):
            return s
        return done.stdout.rstrip() if done.returncode == 0 else s

    return run


def action(spec: dict, replacement: str | None = None, allow_shell: bool = False, shell_timeout: float = 30.0) -> Callable[[str], str]:
    """The function on matched text that a transform action names: ``{"type": "uppercase"}`` and so on."""
    kind, arg = spec["type"], replacement or ""
    if kind in ("fpe_encrypt", "fpe_decrypt"):
        from .fpe import Ff1

        box = Ff1(bytes.fromhex(secret(spec, "key")), bytes.fromhex(secret(spec, "tweak")), int(spec.get("radix", 10)))
        crypt = box.encrypt if kind == "fpe_encrypt" else box.decrypt

        def run(s: str) -> str:
            try:
                return crypt(s)
            except ValueError:
                return s

        return run
    if kind == "mask_deterministic":
        seed, rest = secret(spec, "seed"), {k: spec[k] for k in ("mask_char", "keep_prefix", "keep_suffix") if k in spec}
        return lambda s: mask_deterministic(s, seed, **rest)
    if kind == "shell":
        if not allow_shell:
            raise PermissionError("shell transforms need allow_shell")
        return shell(spec.get("command", arg), shell_timeout)
    if kind == "plugin" or kind not in SIMPLE:
        name, args = (spec["name"], list(spec.get("args", []))) if kind == "plugin" else (kind, [])
        f = REGISTRY[name]
        return lambda s: f(s, args)
    if kind in ("prepend", "append"):
        text = spec.get("text", arg)
        return (lambda s: text + s) if kind == "prepend" else (lambda s: s + text)
    return SIMPLE[kind]


SIMPLE: dict[str, Callable[[str], str]] = {
    "uppercase": str.upper, "lowercase": str.lower, "trim": str.strip, "prepend": str, "append": str, "reverse": lambda s: s[::-1],
    "remove_whitespace": lambda s: "".join(s.split()), "title_case": title_case, "base64_encode": lambda s: base64.b64encode(s.encode()).decode(),
    "base64_decode": base64_decode, "url_encode": url_encode, "url_decode": url_decode, "normalize_whitespace": lambda s: " ".join(s.split()),
    "deduplicate": lambda s: "\n".join(dict.fromkeys(s.split("\n"))), "sort_chars": lambda s: "".join(sorted(s)), "char_count": lambda s: str(len(s)), "word_count": lambda s: str(len(s.split())),
}


def known(spec: dict) -> bool:
    """Whether there is such a transform or plugin."""
    kind = spec.get("type")
    return spec.get("name") in REGISTRY if kind == "plugin" else kind in SIMPLE or kind in REGISTRY or kind in ("shell", "fpe_encrypt", "fpe_decrypt", "mask_deterministic")


def load_plugins(folder: str, timeout: float = 30.0) -> list[str]:
    """Registers every file of a folder as a plugin under its name without ending; a folder that isn't there has none."""
    import os

    if not os.path.exists(folder):
        return []
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    names = []
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        if os.path.isfile(path):
            names.append(os.path.splitext(f)[0])
            register(names[-1], script(path, timeout))
    return names


# What a shell command is warned about, and the words that show it.
SHELL_WARNINGS = (
    ("may modify the filesystem", ("rm ", "rm\t", "rmdir", "del ", "rd ", "mv ", "move ", "cp ", "copy ")),
    ("network access", ("curl ", "wget ", "nc ", "netcat", "ssh ", "scp ", "rsync", "ftp ")),
    ("elevated privileges", ("sudo ", "su ", "chmod ", "chown ", "runas")),
    ("code injection", ("eval ", "exec ")),
)


def shell_warnings(command: str) -> list[str]:
    """What a shell command may do that its author should know of."""
    low = command.lower()
    out = [f"{word.strip()}: {what}" for what, words in SHELL_WARNINGS for word in words if word in low]
    if ">>" in command:
        out.append(">>: appends to a file")
    elif ">" in command and ">&" not in command:
        out.append(">: writes to a file")
    if "$" in command and "$'" not in command:
        out.append("$: variable expansion")
    if "`" in command or "$(" in command:
        out.append("command substitution")
    return out


def secret(spec: dict, name: str) -> str:
    """A value given in the step, or (not both) in a file that the step names."""
    inline, path = spec.get(name), spec.get(f"{name}_file")
    if (inline is None) == (path is None):
        raise ValueError(f"give either {name} or {name}_file")
    if inline is not None:
        return inline
    with open(path) as f:
        return f.read().strip()
