"""What patterns a text holds, and patterns learned from examples."""

from __future__ import annotations

import pyarrow as pa
import regex as rx
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import Pattern
from ..library import BUILTIN

# The detectors of the report, most of them built-in patterns.
DETECTORS = {n: BUILTIN[n] for n in ("email", "ipv4", "phone_us", "date_iso", "date_us", "time_24h", "uuid", "hex_id", "url", "ssn", "credit_card", "api_key")} | {"base64_blob": BUILTIN["base64"]}
EXAMPLES = 3


def report(lines: DataFrame, detectors: dict[str, str] | None = None, with_examples: bool = True) -> DataFrame:
    """(name, matches, lines), and with examples up to three distinct matches of each detector, the smallest ones.

    The detectors are constants of the plan, so a line is read once for all of them; counts are combined before the shuffle,
    and of the examples each task passes on three.
    """
    d = {n: Pattern(p) for n, p in (detectors or DETECTORS).items()}
    # Lists are made of counts, so a pattern without a match costs no list.
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_count("value", F.lit(p.java)).alias("n")) for n, p in d.items()])
    total = lines.select(F.explode(counts).alias("x")).select("x.*").filter("n > 0").groupBy("name").agg(F.sum("n").cast("long").alias("matches"), F.count("*").alias("lines"))
    if not with_examples:
        return total
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract_all("value", F.lit(p.java), F.lit(0)).alias("found")) for n, p in d.items()])
    each = lines.select(F.explode(found).alias("x")).select("x.name", F.explode("x.found").alias("v"))

    def least(batches):  # noqa: ANN001, ANN202
        best: dict[str, list[str]] = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                few = best.setdefault(name, [])
                if v not in few and (len(few) < EXAMPLES or v < few[-1]):
                    few.append(v)
                    few.sort()
                    del few[EXAMPLES:]
        yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, few in best.items() for _ in few], pa.string()), "v": pa.array([v for few in best.values() for v in few], pa.string())})

    few = each.mapInArrow(least, "name string, v string").groupBy("name").agg(F.slice(F.array_sort(F.collect_set("v")), 1, EXAMPLES).alias("examples"))
    return total.join(few, "name")


def suggestions(rows: list, least: int = 5) -> list[dict]:
    """Steps that would mask what the report found often enough."""
    return [{"type": "substitute", "pattern": DETECTORS[r["name"]], "replacement": f"[{r['name'].upper()}]"} for r in sorted(rows, key=lambda r: -r["matches"]) if r["matches"] >= least and r["name"] in DETECTORS]


def _runs(s: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for c in s:
        k = "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else "p"
        if out and out[-1][0] == k and k != "p":
            out[-1] = (k, out[-1][1] + c)
        else:
            out.append((k, c))
    return out


def _candidates(positive: list[str]) -> dict[str, str]:
    out = {f"builtin:{n}": p for n, p in BUILTIN.items()}
    runs = [_runs(p) for p in positive]
    if len({tuple(k for k, _ in r) for r in runs}) == 1 and runs[0]:
        exact, loose = [], []
        for column in zip(*runs):
            texts = {t for _, t in column}
            kind = column[0][0]
            if kind == "p" or len(texts) == 1 and kind != "d":
                exact.append(rx.escape(column[0][1]) if len(texts) == 1 else "[" + "".join(rx.escape(t) for t in sorted(texts)) + "]")
                loose.append(exact[-1])
                continue
            cls = {"d": r"\d", "a": r"\p{L}", "s": r"\s"}[kind]
            sizes = {len(t) for t in texts}
            exact.append(cls + (f"{{{min(sizes)}}}" if len(sizes) == 1 else f"{{{min(sizes)},{max(sizes)}}}"))
            loose.append(cls + "+")
        out["structure"], out["loose structure"] = "".join(exact), "".join(loose)
    head = positive[0]
    for p in positive[1:]:
        while not p.startswith(head):
            head = head[:-1]
    tail = positive[0]
    for p in positive[1:]:
        while not p.endswith(tail):
            tail = tail[1:]
    if head:
        out["prefix"] = rx.escape(head) + r"\S*"
    if tail:
        out["suffix"] = r"\S*" + rx.escape(tail)
    if len(set(positive)) <= 20:
        out["alternatives"] = "|".join(rx.escape(p) for p in sorted(set(positive), key=lambda p: (-len(p), p)))
    sizes = sorted({len(p) for p in positive})
    if all(p.isdigit() for p in positive):
        out["digits"] = rf"\d{{{sizes[0]},{sizes[-1]}}}"
    if all(p.isalnum() and p.isascii() for p in positive):
        out["letters and digits"] = rf"[A-Za-z0-9]{{{sizes[0]},{sizes[-1]}}}"
    return out


#: Examples are written by hand; more than this is no set of examples but a table.
MOST_EXAMPLES = 10_000


def examples(text: str) -> tuple[list[str], list[str]]:
    """Positive (``+``) and negative (``-``) examples, one a line; other lines count as positive, ``#`` begins a comment."""
    rows = [x for x in map(str.strip, text.split("\n")) if x and not x.startswith("#")]
    return [x.removeprefix("+").strip() for x in rows if not x.startswith("-")], [x[1:].strip() for x in rows if x.startswith("-")]


def learn(positive: list[str], negative: list[str] = (), most: int = 5, least: int = 70) -> list[dict]:
    """Patterns that fit the examples: none that fits a negative one; by confidence, shorter first."""
    positive = [p for p in positive if p]
    if len(positive) + len(negative) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} examples")
    if not positive:
        return []
    out = []
    for name, p in _candidates(positive).items():
        c = rx.compile(p)
        good = sum(bool(c.fullmatch(x)) for x in positive) / len(positive)
        bad = sum(bool(c.fullmatch(x)) for x in negative)
        confidence = int(100 * (0.7 * good + 0.3 * (1 - bad / len(negative) if negative else 1)))
        if not bad and good and confidence >= least:
            out.append({"name": name, "pattern": p, "confidence": confidence})
    return sorted(out, key=lambda x: (-x["confidence"], len(x["pattern"]), x["name"]))[:most]


def sample(pattern: str, seed: int = 0) -> str:
    """A string that a plain pattern (classes, groups, bounded repetition) matches."""
    import random
    import re._parser as sp

    draw = random.Random(seed)

    def one(tree) -> str:  # noqa: ANN001
        out = []
        for op, arg in tree:
            n = str(op)
            if n == "LITERAL":
                out.append(chr(arg))
            elif n == "ANY":
                out.append(draw.choice("abc123"))
            elif n == "IN":
                pool = []
                for o, a in arg:
                    if str(o) == "LITERAL":
                        pool.append(chr(a))
                    elif str(o) == "RANGE":
                        pool += [chr(x) for x in range(a[0], a[1] + 1)]
                    elif str(o) == "CATEGORY":
                        pool += {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " "}.get(str(a), "abcxyz019")
                out.append(draw.choice(pool or ["x"]))
            elif n in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = arg
                out += [one(sub) for _ in range(draw.randint(int(low), int(min(high, int(low) + 3))))]
            elif n == "SUBPATTERN":
                out.append(one(arg[-1]))
            elif n == "BRANCH":
                out.append(one(draw.choice(arg[1])))
        return "".join(out)

    return one(sp.parse(pattern))


# The types of conventional commits.
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert")


def commits(df: DataFrame, message: str) -> DataFrame:
    """Adds ``type``, ``scope``, ``breaking`` and ``description`` of conventional commit messages; null type if it is none."""
    head = rf"\A({'|'.join(COMMIT_TYPES)})(?:\(([^)]*)\))?(!)?: ([^\n]+)"
    c = F.col(message)
    ok = c.rlike(head)
    return df.withColumns({
        "type": F.when(ok, F.regexp_extract(c, head, 1)), "scope": F.when(ok, F.nullif(F.regexp_extract(c, head, 2), F.lit(""))),
        "breaking": ok & ((F.regexp_extract(c, head, 3) == "!") | c.rlike(r"(?m)^BREAKING[ -]CHANGE:")), "description": F.when(ok, F.regexp_extract(c, head, 4)),
    })
