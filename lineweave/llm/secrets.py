"""Credentials in source code and configuration.

Method: strings that a public tokenizer cuts into unusually short subwords are unnatural; context rules (the name a value is
given, the form of the value, what refers to a secret instead of being one) turn candidates into findings; redaction replaces
the found characters one for one, so quotes, separators and every offset in the line stay as they are.

A line alone doesn't tell whether it belongs to a private key block or carries on a string of the line before. The scan passes
on only lines that can (markers, lines like those within a block, lone literals); being in unbroken sequence with a marker is
then decided by comparing line numbers with ranks, within chunks of each file, so no file is gathered into one task.

Defined results: null and blank lines hold nothing; a line that comes again under another id is found under each; a lost
original is no case itself but keeps a block together; a block without an end ends where its form does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.log_entries import CHUNK, lines_of
from ..plans import cut
from .subwords import FOLDER, characters_per_subword

#: A string of one script, digits and signs is unnatural below so many characters per subword ...
UNNATURAL = 2.1
#: ... from so many characters on.
UNNATURAL_LENGTH = 20

# How keys of known services look. A part of such a key counts where a line breaks it off.
ISSUED = re.compile(
    r"\b(?:(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,16}|gh[pousr]_[A-Za-z0-9]{12,}|github_pat_\w{12,}|glpat-[\w-]{10,}|gl[a-z]{2,4}-[\w-]{16,}"
    r"|xox[abeprs]-[\w-]{10,}|[spr]k_(?:live|test)_[A-Za-z0-9]{10,}|whsec_[A-Za-z0-9]{10,}|AIza[\w-]{20,}|ya29\.[\w-]{10,}|hv[sbr]\.[\w-]{10,}|npm_[A-Za-z0-9]{12,}|pypi-[\w-]{12,}"
    r"|dop_v1_[a-f0-9]{16,}|SG\.[\w-]{10,}\.?[\w-]*|sk-(?:ant-|proj-)?[\w-]{20,}|hf_[A-Za-z0-9]{16,}|dckr_pat_[\w-]{12,}|AGE-SECRET-KEY-1[A-Z0-9]+|shp(?:at|ss|pa|ca)_[a-fA-F0-9]{16,}"
    r"|eyJ[\w-]{8,}\.(?:eyJ)?[\w-]{6,}(?:\.[\w-]*)?|EAA[A-Za-z0-9]{20,}|sq0[a-z]{3}-[\w-]{16,}|key-[0-9a-f]{32}\b)"
)
#: Words of a name that make its value a secret, and words that make it something about one.
_SECRET_NAME = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credential|cred|apikey|(?:api|access|private|secret|signing|encryption|auth|account|shared|master|service|client|deploy|ssh|storage|license)[_.\- ]?key|auth|bearer|pat|pin|psk|salt)"
)
_ABOUT_NAME = re.compile(
    r"(?i)(?:name|header|ttl|length|len|count|limit|max|min|url|uri|path|file|dir|id|type|alg|algo|algorithm|prefix|suffix|hint|expiry|expires?|expiration|lifetime|public|policy|field|label|param|env|var|ref|arn|hash|digest|checksum|user|username|host|port|enabled|required|regex|pattern|size|format|version|provider|issuer|scope|endpoint|timeout|rotation|algos?|method|mode|bits|rounds)s?"
)
_SPLIT = re.compile(r"[_.\-\s]+|(?<=[a-z0-9])(?=[A-Z])")

# What stands in place of a secret.
_FILLER = re.compile(
    r"(?ix)^(?: [*x.\-_•\#?0]+ | <[^<>]*> | \[[^\]]*\] | \{\{.*\}\} | \$\{?[\w.:\-]+\}?.* | \$\(.*\) | %\(\w+\)[sd] | %\w{1,30}% | %[sdv] | @\w+@ | `.*` "
    r"| (?:replace|change|fill|insert|put|enter|set|add|your|my|todo|fixme|tbd|dummy|example|sample|fake|placeholder|redacted|masked|hidden|removed|censored|test|testing|none|null|nil|undefined|unset|not[-_ ]?set|n/?a|empty|default|changeme|secret|password|token|string|str|required|optional|true|false|yes|no|on|off)(?:[-_ ./]?(?:me|it|this|here|your|set|in|by|env|key|token|secret|password|value|with|the|a|real|at|runtime|deploy|before|use|later|ci|vault))* [!.]* "
    r"| (?:vault|env|ssm|aws[-\w]*|gcp[-\w]*|azure[-\w]*|kms|sops|op|file|secret|secrets|keyring|credstash|doppler|sm|ref|k8s|config|ENC|enc|cipher|keychain|pass|bitwarden|1password|arn|projects)[:(/].* "
    r"| (?:os\.|process\.|System\.|ENV|env\.|getenv|secrets?\.|config\.|settings\.|self\.|args\.|var\.|local\.|data\.|module\.|std::env|Deno\.env|import\.meta|request\.|params\.|ctx\.|this\.|Rails\.|viper\.|conf\.|cfg\.|options\.|props\.|input\.|flags?\.)[\w.\[\]('\"]*.* )$"
)
_ID = re.compile(
    r"(?i)^(?:(?:sha\d+|md5|blake\w*)[:\-].*|data:[\w/+.-]*[;,].*|(?:ssh-(?:rsa|ed25519|dss)|ecdsa-\S+)\s.*|v?\d+(?:\.\d+)*[a-z%]{0,2}|-?\d[\d_,.]*|urn:.*|-----BEGIN (?:PUBLIC|CERTIFICATE|RSA PUBLIC).*)$"
)
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
#: How the keys of ISSUED begin, for a line that breaks one off early.
_BEGUN = re.compile(r"[\"'`](?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[spr]k_(?:live|test)_|AIza|hv[sbr]\.|npm_|pypi-|SG\.|eyJ)[\w.-]*(?=[\"'`]\s*(?:\+|\\|\.|&|,)*\s*\\?$)")
_URL = re.compile(r"\b[a-zA-Z][\w+.-]{1,20}://([^\s:@/'\"`]*):([^\s@/'\"`]+|[^\s'\"`]+?)@(?=[\w\[$.-])")
_HEADER = re.compile(r"(?i)\b(Basic|Bearer|Token|Digest)\s+([A-Za-z0-9+/_=.\-]{8,})")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"?|\'((?:[^\'\\]|\\.)*)\'?|`([^`]*)`?')
#: A name, a separator and a value that isn't quoted.
_BARE = re.compile(r"(?<![\w.])(?:--?|\$)?([A-Za-z_][\w.\-]*)\s*(?::=|=>|[=:])\s*(?![=>\s\"'`])([^\s\"'`,;{}\[\]()<>|&]+)")
_DOCKER = re.compile(r"^\s*(?:ENV|ARG|SetEnv|setenv|machine\s+\S+\s+login\s+\S+)\s+([A-Za-z_]\w*)\s+([^\s=]+)\s*$")
_DEFAULTED = re.compile(r"\$\{([A-Za-z_]\w*):?[=-]([^}]*(?:\}\})?[^}]*)\}")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--|/\*|;|<!--|\*|REM)\s*(.*)$")
_NAMED_IN_TEXT = re.compile(r"(?i)\b(pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|(?:api|access|private|secret|signing|old|new|temp|root|admin|master)[ _-]?key|key|login)\b(?:\s+(?:is|was|for|to|used|now|old|new|temp|staging|prod|dev))*\s*[:=]?\s+([^\s'\"`,;)]{6,})")
_BEFORE = re.compile(r"([A-Za-z_$][\w.\-]*)\s*(?:['\"`]\s*\]?|\]|\))?\s*(?::\s*&?(?:'\w+\s+)?[\w<>\[\], ]+?)?\s*(?::=|=>|\|\||\?\?|[=:,(]|\breturn\b|\s)\s*(?:f|r|b|u|rb|&)?$")
_ASSIGNED = re.compile(r"[\w.\-]['\"`]?\s*[\])]?\s*(?::=|=>|\|\||\?\?|[=:,(])\s*(?:f|r|b|u|rb|&)?$")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*?)(PRIVATE KEY(?: BLOCK)?|PUBLIC KEY(?: BLOCK)?|CERTIFICATE(?: REQUEST)?|[A-Z0-9 ]+?)-----")
_PEM_BODY = re.compile(r"^\s*(?:[\"'`]?[A-Za-z0-9+/]{4,}={0,3}(?:\\n)?[\"'`]?\s*[,+\\]*\s*|(?:Proc-Type|DEK-Info|Comment|Version|Headers?|Key-\w+):.*)?$")
_LONE = re.compile(r"^\s*(?:[+.&|]\s*)?(?:f|r|b)?([\"'`])((?:[^\"'`\\]|\\.)*)\1\s*(?:\+|\\|\.|&|,|\+\s*\\|\)|;|\);|\.\.)?\s*$")
#: A name and its value as fields of one entry, each on a line of its own.
_NAME_FIELD = re.compile(r"^\s*(?:-\s+)?[\"']?(?:name|key|id|variable|env)[\"']?\s*[:=]\s*[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*,?\s*$", re.I)
_VALUE_FIELD = re.compile(r"^\s*[\"']?(?:value|val|default|content)[\"']?\s*[:=]\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'#]+))\s*,?\s*(?:#.*)?$", re.I)
_GOES_ON = re.compile(r"(?:\+\s*\\?|\\|\.\.?|&)\s*$")
_WORTH = re.compile(r"(?i)pass|pwd|\bpw|secret|token|key|auth|cred|bearer|basic|\bpat\b|\bpin\b|psk|salt|login|://[^\s]*@|-----|eyJ|[A-Za-z0-9+/_=.\-]{16,}")

MARK_PRIVATE, MARK_OTHER, MARK_END, BODY, LONE, FOUND, NAMED, VALUED = range(1, 9)


def is_secret_name(name: str) -> bool:
    """Whether a value under this name is a secret: its last telling word says so (``api_key``, not ``api_key_header``)."""
    words = [w for w in _SPLIT.split(name) if w]
    if not words:
        return False
    if _ABOUT_NAME.fullmatch(words[-1]) or (words[0].lower() in ("max", "min", "num", "total", "public") and _SECRET_NAME.search(name)):
        return False
    joined = "_".join(words)
    return any(_SECRET_NAME.fullmatch(w) for w in words) or bool(re.search(r"(?i)(?:api|access|private|secret|signing|encryption|auth|account|shared|master|service|client|deploy|ssh|storage|license)_key|apikey|password|passwd|passphrase", joined))


def literal(value: str, named: bool = False) -> bool:
    """Whether a value can be a secret itself: not blank, a filler, a reference, an id or a digest's form, and unless its
    name says that it is a secret, no number and without spaces."""
    v = value.strip()
    return len(v) >= 4 and not _FILLER.match(v) and (not _ID.match(v) or named and v.isdigit()) and not v.startswith(("http://", "https://", "./", "../", "~/")) and not re.match(r"/[a-z][a-z0-9_.-]*(?:/|$)", v) and (named or " " not in v)


def _strong(value: str, named: bool, folder: str) -> bool:
    """Whether an unquoted or quoted value is a secret given whether its name says so."""
    if not literal(value, named):
        return False
    if named:
        if value.isalpha() and value.islower() and characters_per_subword(value, folder) >= 3.5:
            return False  # a plain word: ``auth = enabled``
        return True
    if _HEX.match(value) or len(value) < UNNATURAL_LENGTH or not re.fullmatch(r"[A-Za-z0-9+/_=.~!$%^*@\-]+", value):
        return False
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    # With two kinds of characters signs are those of names, hosts and addresses.
    return (kinds == 3 or kinds == 2 and value.rstrip("=").isalnum()) and value.count("/") <= len(value) / 12 and characters_per_subword(value, folder) < UNNATURAL


def _port(name: str, value: str) -> bool:
    """Whether a number stands under a name whose last word isn't a secret's: ``auth-01.example:5671``."""
    return value.isdigit() and not is_secret_name("_".join([w for w in _SPLIT.split(name) if w][-2:]))


def find_in_line(text: str, folder: str = FOLDER) -> list[tuple[int, int]]:
    """Spans of secrets in a line by itself."""
    t = text.rstrip("\r\n")
    if not _WORTH.search(t):
        return []
    spans = [m.span() for m in ISSUED.finditer(t)]
    for m in _URL.finditer(t) if "@" in t else ():
        if not _FILLER.match(m[2]):
            spans.append(m.span(2))
    for m in _HEADER.finditer(t):
        if re.search(r"(?i)auth", t[: m.start()]) and not _FILLER.match(m[2]) and (len(m[2]) >= 12 or re.search(r"\d", m[2])):
            spans.append(m.span(2))
    if _GOES_ON.search(t):
        spans += [(m.start() + 1, m.end()) for m in _BEGUN.finditer(t)]
    comment = _COMMENT.search(t)
    after = comment[1].strip() if comment else ""
    for m in _DEFAULTED.finditer(t):
        if is_secret_name(m[1]) and _strong(m[2], True, folder):
            spans.append(m.span(2))
    for m in _QUOTED.finditer(t):
        k = 1 if m[1] is not None else 2 if m[2] is not None else 3
        v = m[k]
        if not v or v.startswith("${") or "-----BEGIN" in v:
            continue
        b = _BEFORE.search(t[: m.start()])
        # cfg.Set("api_key", "..."): the name is the quoted string before.
        name = b[1] if b else ""
        q = re.search(r"[\"'`]([\w.\- ]+)[\"'`]\s*\]?\s*(?:=>|[,:=])\s*$", t[: m.start()])
        if q:
            name = q[1]
        named = is_secret_name(name) or bool(re.fullmatch(r"[\w.\-]+", after) and is_secret_name(after) and m.end() <= comment.start())
        if " " in v and not _ASSIGNED.search(t[: m.start()]):
            continue  # prose: ``auth-gateway: upstream said "try later"``
        if _strong(v, named, folder):
            spans.append(m.span(k))
    unquoted = _QUOTED.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"' if len(m[0]) > 1 else m[0], t)
    for m in [*_BARE.finditer(unquoted), *_DOCKER.finditer(unquoted)]:
        if not re.match(r"(?:true|false|null|none|self|this|str|string|int|bool|Optional|&str|String)\b", m[2]) and not m[2].startswith(("$", "//")) and not re.fullmatch(r"[A-Za-z_][\w.]*\(?.*\(.*|[a-z_]\w*(?:\.\w+)+", m[2]):
            named = is_secret_name(m[1]) and not _port(m[1], m[2])
            if _strong(m[2].rstrip("\\"), named, folder) and not (named and re.match(r"\s*\(", unquoted[m.end() :])):
                spans.append((m.start(2), m.start(2) + len(m[2].rstrip("\\"))))
    # An environment line within quotes: "PASSWORD=...".
    for m in _QUOTED.finditer(t):
        inner = m[1] or m[2] or m[3] or ""
        at = m.start() + 1
        for x in _BARE.finditer(inner):
            if is_secret_name(x[1]) and not _port(x[1], x[2]) and _strong(x[2], True, folder):
                spans.append((at + x.start(2), at + x.end(2)))
    if comment:
        for m in _NAMED_IN_TEXT.finditer(t, comment.start()):
            v = m[2].rstrip(".!") if m[2].endswith(".") else m[2]
            if literal(v) and (re.search(r"\d", v) or v.count("-") >= 2 or characters_per_subword(v, folder) < UNNATURAL) and not _HEX.match(v):
                spans.append((m.start(2), m.start(2) + len(v)))
    return _merged(spans)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def line_kind(text: str, folder: str = FOLDER) -> tuple[int, bool]:
    """(what the line is, whether it ends so that a string goes on); 0 if it neither holds nor can continue a secret."""
    t = text.rstrip("\r\n")
    if "-----" in t:
        marks = list(_PEM.finditer(t))
        if marks:
            last = marks[-1]
            private = "PRIVATE" in last[3]
            if any(m[1] == "BEGIN" and "PRIVATE" in m[3] for m in marks) and last[1] == "END":
                return FOUND, False
            if last[1] == "BEGIN":
                return (MARK_PRIVATE if private else MARK_OTHER), False
            return (MARK_END if private else MARK_OTHER), False
    if find_in_line(t, folder):
        return FOUND, bool(_GOES_ON.search(t))
    if (m := _NAME_FIELD.match(t)) and is_secret_name(m[1]):
        return NAMED, False
    if (m := _VALUE_FIELD.match(t)) and _strong(m[1] or m[2] or m[3] or "", True, folder):
        return VALUED, False
    if _LONE.match(t):
        return LONE, bool(_GOES_ON.search(t))
    return (BODY, False) if _PEM_BODY.match(t) else (0, False)


def _with_extent(df: DataFrame) -> DataFrame:
    """``secret``: the line is found by itself, belongs to a private key block, carries on a found string, or is the value
    of an entry that the line above gives a secret's name.

    Two lines are in unbroken sequence if their numbers differ by as much as their ranks among the lines passed on; ranks
    are those within the chunk plus the number of lines in the chunks before.
    """
    rows = df.withColumn("chunk", F.floor(F.col("line_number") / CHUNK)).repartition("path", "chunk")
    per = rows.groupBy("path", "chunk").agg(F.countDistinct("line_number").alias("n"))
    c = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("path", "chunk", F.coalesce(F.sum("n").over(c), F.lit(0)).alias("_before"))
    w = Window.partitionBy("path", "chunk").orderBy("line_number")
    rows = rows.withColumn("_rank", F.dense_rank().over(w)).join(before, ["path", "chunk"])
    rows = rows.withColumn("_key", F.col("line_number") - F.col("_rank") - F.col("_before"))
    mark = F.when(F.col("kind").isin(MARK_PRIVATE, MARK_OTHER, MARK_END), F.struct("kind", "_key"))
    # What a lone literal can carry on: the line before it, unless that is a lone literal that ends there.
    head = F.when((F.col("kind") != LONE) | ~F.col("goes_on"), F.struct("kind", "_key", "goes_on", "line_number"))
    rows = rows.withColumns({"_mark": mark, "_head": head})
    s = Window.partitionBy("path", "chunk").orderBy("line_number", "line_id")
    ends = rows.groupBy("path", "chunk").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct("line_number", "line_id"))).alias("m"), F.max_by("_head", F.when(F.col("_head").isNotNull(), F.struct("line_number", "line_id"))).alias("h"))
    carry = ends.select("path", "chunk", F.last("m", True).over(c).alias("_m"), F.last("h", True).over(c).alias("_h"))
    above = Window.partitionBy("path", "chunk").orderBy("line_number").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_mark": F.last("_mark", True).over(s), "_head": F.last("_head", True).over(above)}).join(carry, ["path", "chunk"], "left")
    m, h = F.coalesce("_mark", "_m"), F.coalesce("_head", "_h")
    in_block = (F.col("kind").isin(BODY, LONE)) & (m["kind"] == MARK_PRIVATE) & (m["_key"] == F.col("_key"))
    carried_on = (F.col("kind") == LONE) & (h["kind"] == FOUND) & h["goes_on"] & (h["_key"] == F.col("_key"))
    valued = (F.col("kind") == VALUED) & (h["kind"] == NAMED) & (F.col("line_number") - h["line_number"] == 1)
    alone = F.col("kind").isin(FOUND, MARK_PRIVATE, MARK_END)
    return rows.select("path", "line_number", "line_id", "kind", "own", F.coalesce(alone | in_block | carried_on | valued, F.lit(False)).alias("secret"))


def repo_lines(line_matches: DataFrame, file_results: DataFrame, under: str) -> DataFrame:
    paths = file_results.filter(F.col("path").startswith(under)).select("path").distinct()
    return lines_of(line_matches.filter(F.col("path").startswith(under))).join(paths, "path", "left_semi")


def find_secret_lines(line_matches: DataFrame, file_results: DataFrame, under: str = "/repo/", folder: str = FOLDER) -> DataFrame:
    """(path, line_number, line_id, kind, own, secret) of the lines that can hold a secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, bool]] = {}
        for batch in batches:
            kinds = []
            for t in batch.column(3).to_pylist():
                got = known.get(t)
                if got is None:
                    if len(known) > 50_000:
                        known.clear()
                    got = known[t] = line_kind(t, folder)
                kinds.append(got)
            keep = pa.array([i for i, k in enumerate(kinds) if k[0]], pa.int32())
            kept = [k for k in kinds if k[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), batch.column(2).take(keep), batch.column(4).take(keep), pa.array([k[0] for k in kept], pa.int8()), pa.array([k[1] for k in kept], pa.bool_())],
                ["path", "line_number", "line_id", "own", "kind", "goes_on"],
            )

    lines = repo_lines(line_matches, file_results, under)
    return _with_extent(cut(lines.mapInArrow(run, "path string, line_number bigint, line_id bigint, own boolean, kind tinyint, goes_on boolean")))


def find_secrets(line_matches: DataFrame, file_results: DataFrame, under: str = "/repo/", folder: str = FOLDER) -> DataFrame:
    return find_secret_lines(line_matches, file_results, under, folder).filter("secret and own").select("line_id")


def redact_line(text: str, kind: int, folder: str = FOLDER) -> str:
    """The line with its secrets' letters and digits replaced one for one; quotes, signs and length stay."""
    if kind in (MARK_PRIVATE, MARK_END):
        return text
    if kind == BODY:
        return re.sub(r"[A-Za-z0-9+/]", "x", text.replace("\\n", "\x00")).replace("\x00", "\\n")
    if kind == VALUED:
        m = _VALUE_FIELD.match(text.rstrip("\r\n"))
        a, b = m.span(m.lastindex) if m else (0, 0)
        return text[:a] + re.sub(r"[A-Za-z0-9]", "x", text[a:b]) + text[b:]
    if kind == LONE:
        return re.sub(r"(?<=[\"'`]).*(?=[\"'`])", lambda m: re.sub(r"[A-Za-z0-9]", "x", m[0]), text)
    out = list(text)
    for a, b in find_in_line(text, folder) or [(m.end(), e.start()) for m, e in zip(re.finditer(r"-----BEGIN [A-Z0-9 ]+-----", text), re.finditer(r"-----END", text))]:
        for i in range(a, b):
            if out[i] not in "\\\"'`" and not (out[i] == "n" and i and text[i - 1] == "\\"):
                out[i] = "x"
    return "".join(out)


def redact_lines(line_matches: DataFrame, file_results: DataFrame, under: str = "/repo/", folder: str = FOLDER) -> DataFrame:
    """(line_id, path, line_number, redacted) of every line under ``under``; lines without secrets come out as they are."""
    found = find_secret_lines(line_matches, file_results, under, folder).filter("secret").select("line_id", F.col("kind").cast("int").alias("kind"))

    @F.pandas_udf("string")
    def redacted(texts, kinds):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([redact_line(t, int(k), folder) for t, k in zip(texts, kinds)], dtype=object)

    lines = repo_lines(line_matches, file_results, under).join(found, "line_id", "left")
    return lines.select("line_id", "path", "line_number", F.when(F.col("kind").isNull(), F.col("text")).otherwise(redacted("text", F.coalesce("kind", F.lit(0)))).alias("redacted"))
