"""Rules over several files: where a trigger matches, related files must hold a pattern.

Rules are configuration (checked against ``MOST_RULES``) and are unrolled into the plan; files are never paired with each
other.
"""

from __future__ import annotations

import fnmatch
import posixpath
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import Pattern

MOST_RULES = 500


@dataclass(frozen=True)
class Rule:
    name: str
    trigger_pattern: str
    trigger_files: str = "*"
    related_files: str = "*"
    ensure_pattern: str | None = None
    action: str = "warn"
    atomic: bool = False
    description: str | None = None
    related_path_template: str | None = None
    enabled: bool = True


def rules_of(raw: dict) -> list[Rule]:
    return [Rule(**{k: v for k, v in r.items() if k in Rule.__dataclass_fields__}) for r in raw.get("rule", raw.get("cross_file_rule", []))]


def _glob(c, pattern: str):  # noqa: ANN001, ANN202
    return c.rlike(fnmatch.translate(pattern).replace("\\Z", "\\z"))


def triggers(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, source, line_no, matched): the first match of each line for each enabled rule."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hits = [F.struct(F.lit(r.name).alias("rule"), F.when(_glob(F.col("source"), r.trigger_files) & F.col("value").rlike(Pattern(r.trigger_pattern).java), F.regexp_extract("value", Pattern(r.trigger_pattern).java, 0)).alias("matched")) for r in rules if r.enabled]
    if not hits:
        return lines.select(F.lit("").alias("rule"), "source", "line_no", F.lit("").alias("matched")).filter("false")
    return lines.select("source", "line_no", F.explode(F.array(*hits)).alias("h")).filter("h.matched is not null").select("h.rule", "source", "line_no", "h.matched")


def related_path(template: str, source: str) -> str:
    """``{dir}``, ``{stem}``, ``{ext}`` and ``{name}`` of the triggering file in a path."""
    name = posixpath.basename(source)
    stem, ext = posixpath.splitext(name)
    return template.format(dir=posixpath.dirname(source), stem=stem, ext=ext.lstrip("."), name=name)


def _related(template: str, source: Column) -> Column:
    """``related_path`` as an expression."""
    folder, name = F.regexp_extract(source, r"^(.*?)/*[^/]*$", 1), F.regexp_extract(source, r"([^/]*)$", 1)
    ending = r"^(\.*[^.].*)\.([^.]*)$"
    stem, ext = F.when(name.rlike(ending), F.regexp_extract(name, ending, 1)).otherwise(name), F.regexp_extract(name, ending, 2)
    parts = {"dir": folder, "name": name, "stem": stem, "ext": ext}
    out = []
    for text, key, _, _ in Formatter().parse(template):
        out += [F.lit(text)] + ([parts[key]] if key is not None else [])
    return F.concat(*out) if out else F.lit("")


def _states(lines: DataFrame, ensured: list[Rule]) -> DataFrame:
    """(source, rule, has): of each related file of each rule, whether it holds the rule's pattern anywhere."""
    state = [F.when(_glob(F.col("source"), r.related_files), F.struct(F.lit(r.name).alias("rule"), F.col("value").rlike(Pattern(r.ensure_pattern).java).alias("has"))) for r in ensured]
    return lines.select("source", F.explode(F.array_compact(F.array(*state))).alias("s")).groupBy("source", F.col("s.rule").alias("rule")).agg(F.max("s.has").alias("has"))


def _targets(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, source, related_source): where rules name a related path, that of each triggering file."""
    out = found.select("rule", "source", F.lit("").alias("related_source")).filter("false")
    for r in rules:
        out = out.unionByName(found.filter(F.col("rule") == r.name).select("rule", "source").distinct().withColumn("related_source", _related(r.related_path_template, F.col("source"))))
    return out


def check(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, related_source, triggers, first_source, first_line): each related file that lacks its rule's pattern.

    A file is a row once for a rule, with how many triggers in other files ask for the pattern and the first of them;
    ``triggers`` has them all. So the result is as large as its files, not as the pairs of triggers and files. A file
    without triggers of its rule passes, and so does a trigger whose rule has no related file.
    """
    found = triggers(lines, rules)
    ensured = [r for r in rules if r.enabled and r.ensure_pattern]
    if not ensured:
        return found.select("rule", F.col("source").alias("related_source"), F.lit(0).cast("long").alias("triggers"), F.lit("").alias("first_source"), "line_no").withColumnRenamed("line_no", "first_line").filter("false")
    lacking = _states(lines, ensured).filter("not has").select(F.col("source").alias("related_source"), "rule")
    templated = [r for r in ensured if r.related_path_template]
    plain = found.filter(~F.col("rule").isin([r.name for r in templated])) if templated else found
    k = F.struct("source", "line_no")
    own = plain.groupBy("rule", "source").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    # Of each rule its triggers, and the first one of each of the first two files: one of them isn't the file itself.
    total = own.groupBy("rule").agg(F.sum("n").alias("all"), F.min(k).alias("k1"))
    second = own.join(total, "rule").filter(F.col("source") != F.col("k1.source")).groupBy("rule").agg(F.min(k).alias("k2"))
    j = lacking.join(total.join(second, "rule", "left"), "rule").join(own.select("rule", F.col("source").alias("related_source"), F.col("n").alias("mine")), ["rule", "related_source"], "left")
    first = F.when(F.col("k1.source") != F.col("related_source"), F.col("k1")).otherwise(F.col("k2"))
    out = j.select("rule", "related_source", (F.col("all") - F.coalesce("mine", F.lit(0))).alias("triggers"), first.alias("f")).filter("triggers > 0")
    if templated:
        at = found.join(_targets(found, templated), ["rule", "source"]).join(lacking, ["rule", "related_source"])
        out = out.unionByName(at.groupBy("rule", "related_source").agg(F.count("*").alias("triggers"), F.min(k).alias("f")))
    return out.select("rule", "related_source", "triggers", F.col("f.source").alias("first_source"), F.col("f.line_no").alias("first_line"))


def fixes(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(related_source, appended): what to append to each violating file: the matched texts of its rule, each once, in order.

    The texts of a rule are put together once, not for each file.
    """
    found = triggers(lines, rules)
    templated = {r.name for r in rules if r.related_path_template}
    texts = lambda df, *by: df.groupBy(*by, "matched").agg(F.min(F.struct("source", "line_no")).alias("k")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "matched"))).alias("t"))
    bad = check(lines, rules).select("rule", "related_source")
    per = bad.join(texts(found.filter(~F.col("rule").isin(list(templated))) if templated else found, "rule"), "rule")
    if templated:
        at = found.join(_targets(found, [r for r in rules if r.name in templated]), ["rule", "source"])
        per = per.unionByName(bad.join(texts(at, "rule", "related_source"), ["rule", "related_source"]).select(*per.columns))
    merged = per.groupBy("related_source").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))  # a list for each rule
    return merged.select("related_source", F.array_join(F.array_distinct(F.transform("t", lambda x: x["matched"])), "\n").alias("appended"))


def groups(found: DataFrame, lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, source): files that an atomic rule changes together, the triggering ones and the related ones; the first rule wins."""
    atomic = [r for r in rules if r.enabled and r.atomic]
    fired = found.filter(F.col("rule").isin([r.name for r in atomic])).select("rule", "source").distinct()
    rel = None
    for r in atomic:
        x = lines.select("source").distinct().filter(_glob(F.col("source"), r.related_files)).select(F.lit(r.name).alias("rule"), "source").join(fired.select("rule").distinct(), "rule", "left_semi")
        rel = x if rel is None else rel.unionByName(x)
    every = fired if rel is None else fired.unionByName(rel)
    order = F.array_position(F.array(*[F.lit(r.name) for r in atomic]) if atomic else F.array(F.lit("")), F.col("rule"))
    return every.withColumn("o", order).groupBy("source").agg(F.min_by("rule", "o").alias("rule")).select("rule", "source")


def outcome(violations: int, action: str) -> tuple[bool, str]:
    """(whether to go on, what to say) for the actions ``warn``, ``fail``, ``skip`` and ``fix``."""
    if not violations or action == "skip":
        return True, ""
    say = f"{violations} files lack what a rule asks for"
    return action != "fail", say if action != "fix" else f"{say}; fixing"
