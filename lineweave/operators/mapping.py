"""Reversible mappings: what was replaced by what, and the way back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import Pattern
from ..spec import Pipeline, SpecError, Step

INVERSE = {"base64_encode": "base64_decode", "base64_decode": "base64_encode", "url_encode": "url_decode", "url_decode": "url_encode", "reverse": "reverse", "fpe_encrypt": "fpe_decrypt", "fpe_decrypt": "fpe_encrypt"}


def record(lines: DataFrame, step: Step, index: int, now: int = 0) -> DataFrame:
    """(original, transformed, step_index, pattern, created_at): each distinct match of a substitute step and its replacement."""
    from ..engine import replaced

    p = Pattern(step.pattern, frozenset(step.flags or ()) - {"global"})
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(p.java), F.lit(0))).alias("original")).distinct()
    return found.select("original", replaced(p, F.col("original"), step.replacement or "", True).alias("transformed"), F.lit(index).alias("step_index"), F.lit(step.pattern).alias("pattern"), F.lit(now).cast("long").alias("created_at"))


def current(entries: DataFrame, side: str) -> DataFrame:
    """The last entry of each original (or transformed) text; equal times go to the greater step, then text."""
    other = "transformed" if side == "original" else "original"
    return entries.groupBy(side).agg(F.max_by(F.struct(other, "step_index"), F.struct("created_at", "step_index", other)).alias("e")).select(side, f"e.{other}", "e.step_index")


def apply(values: DataFrame, entries: DataFrame, reverse: bool = False, strict: bool = False) -> DataFrame:
    """(value, mapped): each value's current mapping; unmapped values stay, or with ``strict`` become null."""
    side, other = ("transformed", "original") if reverse else ("original", "transformed")
    j = values.join(current(entries, side).select(F.col(side).alias("value"), F.col(other).alias("mapped")), "value", "left")
    return j if strict else j.withColumn("mapped", F.coalesce("mapped", "value"))


def ambiguous(entries: DataFrame) -> DataFrame:
    """(transformed, originals): replacements that stand for several originals, which no way back can tell apart."""
    return entries.groupBy("transformed").agg(F.count_distinct("original").alias("originals")).filter("originals > 1")


def statistics(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.count_distinct("original").alias("originals"), F.count_distinct("transformed").alias("replacements"), F.count_distinct("step_index").alias("steps"))


def irreversible(p: Pipeline) -> list[str]:
    out = []
    for i, s in p.active:
        if s.type in ("filter", "extract", "block"):
            out.append(f"step {i}: {s.type} loses lines or text")
        elif s.type == "transform" and s.transform["type"] not in INVERSE:
            out.append(f"step {i}: {s.transform['type']} has no inverse")
        elif s.type == "substitute" and Pattern(s.pattern).groups:
            out.append(f"step {i}: the replacement refers to groups")
    return out


def reversed_pipeline(p: Pipeline) -> Pipeline:
    """The steps in reverse order, each undoing what the original did."""
    bad = irreversible(p)
    if bad:
        raise SpecError("; ".join(bad))
    import regex as rx

    out = []
    for _, s in reversed(p.active):
        if s.type == "substitute":
            literal = rx.sub(r"\\(.)", r"\1", s.pattern)
            out.append(replace(s, pattern=rx.escape(s.replacement or ""), replacement=literal.replace("$", "$$")))
        elif s.type == "transform":
            out.append(replace(s, transform=s.transform | {"type": INVERSE[s.transform["type"]]}))
        else:
            out.append(s)
    return replace(p, steps=tuple(out))
