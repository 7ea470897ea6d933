"""Tests written in pipeline definitions: run all of them in one job each kind, report as text, TAP or JUnit."""

from __future__ import annotations

from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import run
from .sources.lines import split_lines
from .spec import Pipeline


@dataclass
class Outcome:
    name: str
    passed: bool
    skipped: bool = False
    message: str = ""


def run_tests(spark: SparkSession, p: Pipeline, tags: set[str] | None = None, names: str | None = None) -> list[Outcome]:
    """Each test's input is a source of its own, so one run covers them all."""
    chosen = [(i, t) for i, t in enumerate(p.tests) if (not tags or tags & set(t.get("tags", []))) and (not names or names in t["name"])]
    active = [(i, t) for i, t in chosen if not t.get("skip")]
    got: dict[int, str] = {i: "" for i, _ in active}
    matches: dict[int, tuple[int, int]] = {}
    if active:
        lines = split_lines(spark.createDataFrame([(i, t["input"]) for i, t in active], "source int, text string"), "source", "text")
        for r in run(p, lines).lines.orderBy("source", "line_no").collect():  # as many rows as the definition's own tests have
            got[r.source] += r.value + "\n"
        if any("expected_matches" in t or "expected_transformations" in t for _, t in active):
            traced = run(p, lines, stats=True).traced
            m = [c for c in traced.columns if c.startswith("_m")]
            x = [c for c in traced.columns if c.startswith("_t")]
            total = lambda cols: F.sum(sum((F.col(c) for c in cols), F.lit(0)))
            matches = {r.source: (r.m, r.t) for r in traced.groupBy("source").agg(total(m).alias("m"), total(x).alias("t")).collect()}
    out = []
    for i, t in chosen:
        if t.get("skip"):
            out.append(Outcome(t["name"], True, True, t.get("skip_reason") or ""))
            continue
        why = []
        if "expected" in t and t["expected"] is not None and got[i].rstrip("\n") != t["expected"].rstrip("\n"):
            why.append(f"expected {t['expected']!r}, got {got[i]!r}")
        if t.get("should_not_match") and got[i].rstrip("\n") != t["input"].rstrip("\n") and got[i]:
            why.append(f"should not match, got {got[i]!r}")
        for key, k in (("expected_matches", 0), ("expected_transformations", 1)):
            if t.get(key) is not None and matches.get(i, (0, 0))[k] != t[key]:
                why.append(f"{key} {t[key]}, got {matches.get(i, (0, 0))[k]}")
        out.append(Outcome(t["name"], not why, False, "; ".join(why)))
    return out


def text_report(found: list[Outcome]) -> str:
    rows = [f"{'skip' if o.skipped else 'ok' if o.passed else 'FAIL'} {o.name}{': ' + o.message if o.message else ''}" for o in found]
    done = [o for o in found if not o.skipped]
    return "\n".join([*rows, f"{sum(o.passed for o in done)} of {len(done)} passed, {len(found) - len(done)} skipped"])


def tap(found: list[Outcome]) -> str:
    rows = [f"{'ok' if o.passed else 'not ok'} {n} - {o.name}{' # SKIP ' + o.message if o.skipped else ''}" for n, o in enumerate(found, 1)]
    return "\n".join(["TAP version 14", f"1..{len(found)}", *rows])


def junit(found: list[Outcome], suite: str = "pipeline") -> str:
    cases = []
    for o in found:
        inner = "<skipped/>" if o.skipped else "" if o.passed else f"<failure>{escape(o.message)}</failure>"
        cases.append(f"<testcase name={quoteattr(o.name)}>{inner}</testcase>")
    return f'<testsuite name={quoteattr(suite)} tests="{len(found)}" failures="{sum(not o.passed for o in found)}" skipped="{sum(o.skipped for o in found)}">{"".join(cases)}</testsuite>'
