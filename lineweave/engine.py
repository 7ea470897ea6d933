"""Lowering of pipelines to DataFrame operations on lines (source, line_no, value).

A line keeps its number and its original text (``orig``); a dropped line is filtered out at once, or with ``trace`` kept with
the step that dropped it (``dropped_by``). Steps that look at one line only become column expressions, which Catalyst fuses;
only matches that need a function of their own, and patterns that can match nothing, go through Arrow batches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import transforms as tf
from .functions.regex import Pattern, expand, has_backreference, java_template, matches, substitute, template
from .operators import ordered
from .spec import Counter, Finalize, Pipeline, Settings, SpecError, Step, problems

ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[PX^_].*?\x1b\\|[@-Z\\-_])"


@dataclass
class Result:
    """lines: (source, line_no, value); errors: (source, line_no, step_index, error_type, message, context)."""

    lines: DataFrame
    original: DataFrame
    errors: DataFrame | None = None
    traced: DataFrame | None = None
    stats: DataFrame | None = None


def hits(p: Pattern, c: Column) -> Column:
    if p.fixed:
        return F.contains(c, F.lit(p.source))
    if not set(p.source) & set("\\^$.|?*+()[]{}") and "case_insensitive" not in p.flags and "extended" not in p.flags:
        return F.contains(c, F.lit(p.source))
    return F.contains(c, F.lit(p.required)) & c.rlike(p.java) if p.required else c.rlike(p.java)


def count(p: Pattern, c: Column) -> Column:
    if p.fixed:
        return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(p.source), F.lit("")))) / len(p.source)).cast("long") if p.source else F.lit(0)
    if p.nullable:
        return F.pandas_udf(lambda s: s.map(lambda x: len(matches(p, x)) if x is not None else 0).astype("int64"), "long")(c)
    return F.regexp_count(c, F.lit(p.java)).cast("long")


def replaced(p: Pattern, c: Column, text: str, every: bool, backtracking: bool = False) -> Column:
    if p.fixed and every:
        return F.replace(c, F.lit(p.source), F.lit(text)) if p.source else c
    tokens = [text] if p.fixed else template(text, p, backtracking)
    if p.fixed:
        at = F.instr(c, p.source)
        return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(text), F.substring(c, at + len(p.source), F.char_length(c)))).otherwise(c)
    if not p.nullable and every:
        new = F.regexp_replace(c, p.java, java_template(tokens))
        return F.when(F.contains(c, F.lit(p.required)), new).otherwise(c) if p.required else new
    if not p.nullable and not has_backreference(p.source):
        # Only the first match: what is before and behind it is captured around the pattern, whose groups move by one.
        return F.regexp_replace(c, p.prefix + r"\A((?s:.*?))(?<lwhit>" + p.body + r")((?s:.*))\z", "$1" + java_template([t if isinstance(t, str) else t + 2 for t in tokens]) + f"${p.groups + 3}")
    return F.pandas_udf(lambda s: s.map(lambda x: substitute(p, x, lambda m: expand(tokens, m), every)[0] if x is not None else None), "string")(c)


def _per_match(p: Pattern, f, every: bool):  # noqa: ANN001, ANN202
    return F.pandas_udf(lambda s: s.map(lambda x: substitute(p, x, lambda m: f(m[0]), every)[0] if x is not None else None), "string")


def transformed(s: Step, p: Pattern, c: Column, settings: Settings) -> Column:
    kind = s.transform["type"]
    f = tf.column(s.transform, s.replacement)
    if p.source in tf.WHOLE and not p.fixed and f is not None:
        one = (lambda x: F.when(x != "", f(x)).otherwise(x)) if "+" in p.source else f
        # A rewritten line may hold line feeds, which the pattern doesn't cross (and an anchored one then doesn't match).
        many = c if p.source.startswith("^") else F.array_join(F.transform(F.split(c, "\n"), one), "\n")
        return F.when(F.contains(c, F.lit("\n")), many).otherwise(one(c))
    if kind in ("prepend", "append") and not p.fixed and not p.nullable and s.is_global:
        text = s.transform.get("text", s.replacement or "")
        return F.regexp_replace(c, p.java, java_template([text, 0] if kind == "prepend" else [0, text]))
    return _per_match(p, tf.action(s.transform, s.replacement, settings.allow_shell, settings.shell_timeout_secs), s.is_global)(c)


def extracted(s: Step, p: Pattern, c: Column, first_line: Column) -> Column:
    """What an extract step makes of a line; null where nothing matches."""
    once = s.first_only or not s.is_global
    if s.output_format == "text" and s.output_template is None and not p.nullable and not p.fixed:
        found = F.regexp_extract_all(c, F.lit(p.java), F.lit(0))
        found = F.slice(found, 1, 1) if once else found
        return F.when(F.size(found) > 0, F.array_join(found, "\t" if s.replacement is None else s.replacement))
    names = list(s.capture_names)

    def one(x: str | None, head: bool) -> str | None:
        found = matches(p, x) if x is not None else []
        found = found[:1] if once else found
        if not found:
            return None
        if s.output_template is not None:
            rows = []
            for m in found:
                t = s.output_template
                for k in range(m.re.groups, -1, -1):
                    t = t.replace(f"${{{k}}}", m[k] or "").replace(f"${k}", m[k] or "")
                for k, n in enumerate(names, 1):
                    t = t.replace(f"${{{n}}}", (m[k] or "") if k <= m.re.groups else "")
                rows.append(t)
            return "\n".join(rows)
        if s.output_format in ("json", "jsonl"):
            objects = [{n: m[k] for k, n in enumerate(names, 1) if k <= m.re.groups and m[k] is not None} if names else {f"group_{k}": m[k] for k in range(m.re.groups + 1) if m[k] is not None} for m in found]
            dump = lambda o: json.dumps(o, ensure_ascii=False, separators=(",", ":"))
            return dump(objects) if s.output_format == "json" else "\n".join(map(dump, objects))
        if s.output_format == "csv":
            quote = lambda v: '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\n') else v
            rows = [",".join(quote(m[k] or "") for k in range(1, (len(names) or m.re.groups) + 1) if k <= m.re.groups) for m in found]
            return "\n".join(([",".join(names)] if names and head else []) + rows)
        return ("\t" if s.replacement is None else s.replacement).join(m[0] for m in found)

    return F.pandas_udf(lambda v, h: pd.Series([one(x, y) for x, y in zip(v, h)], dtype=object), "string")(c, first_line)


def numbered(s: Step) -> bool:
    """Whether a step puts running numbers in."""
    return s.type == "substitute" and ("${seq}" in (s.replacement or "") or "${count}" in (s.replacement or ""))


class _Run:
    def __init__(self, p: Pipeline, lines: DataFrame, trace: bool, stats: bool, reverse: bool = False) -> None:
        found = problems(p)
        if found:
            raise SpecError("; ".join(found))
        self.p, self.settings, self.trace, self.stats = p, p.settings, trace or stats, stats
        self.lines, self.counting = lines, frozenset()
        value = F.regexp_replace("value", ANSI, "") if self.settings.strip_ansi else F.col("value")
        self.original = lines.select("source", F.col("line_no").cast("long").alias("line_no"), "value").filter("value is not null")
        self.df = self.original.select("source", "line_no", F.col("value").alias("orig"), value.alias("value"))
        if self.trace:
            self.df = self.df.withColumn("dropped_by", F.lit(None).cast("int"))
        self.errors: list[DataFrame] = []
        self.metrics: list[str] = []
        self.bypass: DataFrame | None = None

    def alive(self) -> Column:
        return F.col("dropped_by").isNull() if self.trace else F.lit(True)

    def keep(self, cond: Column, i: int) -> None:
        if self.trace:
            self.df = self.df.withColumn("dropped_by", F.when(self.alive() & ~F.coalesce(cond, F.lit(False)), F.lit(i)).otherwise(F.col("dropped_by")))
        else:
            self.df = self.df.filter(cond)

    def put(self, value: Column) -> None:
        self.df = self.df.withColumn("value", F.when(self.alive(), value).otherwise(F.col("value")) if self.trace else value)

    def measure(self, i: int, n: Column, changed: Column | None = None) -> None:
        """The step's own columns: lines in, matches, changed lines."""
        if self.stats:
            a = self.alive()
            self.df = self.df.withColumns({f"_in{i}": a.cast("int"), f"_m{i}": F.when(a, n.cast("long")).otherwise(0), f"_t{i}": F.when(a, (changed if changed is not None else F.lit(False)).cast("int")).otherwise(0)})
            self.metrics.append(str(i))

    def line_limits(self) -> None:
        s = self.settings
        if s.sample_limit:
            self.df = self.df.filter(F.col("line_no") <= s.sample_limit)
        if s.max_line_length:
            long_ = F.octet_length("orig") + 1 > s.max_line_length
            if s.max_line_action == "truncate":
                n = s.max_line_length
                self.df = self.df.withColumn("value", F.when(long_, F.pandas_udf(lambda v: v.map(lambda x: x.encode()[:n].decode("utf-8", "ignore") if x is not None else None), "string")("value")).otherwise(F.col("value")))
            else:
                if s.max_line_action == "error":
                    self.errors.append(self.df.filter(long_).select("source", "line_no", F.lit(-1).alias("step_index"), F.lit("line_too_long").alias("error_type"), F.lit(f"longer than {s.max_line_length} bytes").alias("message"), F.col("orig").alias("context")))
                else:  # emitted as it is, past all steps
                    self.bypass = self.df.filter(long_).select("source", "line_no", "orig", F.col("orig").alias("value"))
                self.df = self.df.filter(~long_)

    def line_step(self, i: int, s: Step) -> None:
        p = s.compiled(s.pattern, self.settings)
        v = F.col("value")
        if s.type == "filter":
            self.filter(i, s, p, v)
        elif s.type == "substitute":
            self.substitute(i, s, p, v)
        elif s.type == "extract":
            if self.stats:
                self.measure(i, count(p, v), hits(p, v))
            head = F.lit(False)
            if s.output_format == "csv" and s.capture_names:
                first = self.df.filter(self.alive() & hits(p, v)).groupBy("source").agg(F.min("line_no").alias("_first"))
                self.df = self.df.join(first, "source", "left")
                head = F.coalesce(F.col("line_no") == F.col("_first"), F.lit(False))
            self.df = self.df.withColumn("_x", extracted(s, p, v, head)).drop("_first")
            self.keep(F.col("_x").isNotNull(), i)
            self.put(F.col("_x"))
            self.df = self.df.drop("_x")
            if s.deduplicate and self.trace:
                left = dedup_pieces(self.df.filter(self.alive())).select("source", "line_no", F.col("value").alias("_left"))
                self.df = self.df.join(left, ["source", "line_no"], "left")
                self.keep(F.col("_left").isNotNull(), i)
                self.put(F.col("_left"))
                self.df = self.df.drop("_left")
            elif s.deduplicate:
                self.df = dedup_pieces(self.df)
        elif s.type == "validate":
            ok = hits(p, v)
            self.measure(i, ok.cast("int"))
            how = s.on_mismatch or "error"
            if how == "error":
                self.errors.append(self.df.filter(self.alive() & ~ok).select("source", "line_no", F.lit(i).alias("step_index"), F.lit("validation").alias("error_type"), F.lit(f"no match for {s.pattern}").alias("message"), v.alias("context")))
            if how != "warn":
                self.keep(ok, i)
        elif s.type == "transform":
            new = transformed(s, p, v, self.settings)
            self.measure(i, self.replacements(s, p, v), new != v) if self.stats else None
            self.put(new)
        elif s.type == "block":
            self.block(i, s)

    def filter(self, i: int, s: Step, p: Pattern, v: Column) -> None:
        raw = hits(p, v)
        self.measure(i, raw.cast("int"))
        if s.action == "deduplicate_by_prefix":
            whole = F.regexp_extract(v, p.java, 1) if p.groups else F.lit("")
            key = F.when(raw & (F.lit(p.groups) > 0) & (whole != ""), F.concat(F.lit("g"), whole)).otherwise(F.concat(F.lit("l"), v))
            if self.trace:
                seen = ordered.first_seen(self.df.filter(self.alive()), key).select("source", "line_no", F.lit(True).alias("_seen"))
                self.df = self.df.join(seen, ["source", "line_no"], "left")
                self.keep(F.col("_seen"), i)
                self.df = self.df.drop("_seen")
            else:
                self.df = ordered.first_seen(self.df, key)
            return
        if s.not_pattern:
            raw = raw & ~hits(s.compiled(s.not_pattern, self.settings), v)
        if self.settings.invert_match:
            raw = ~raw
        self.keep(raw if str(s.action).startswith("keep") else ~raw, i)

    def substitute(self, i: int, s: Step, p: Pattern, v: Column) -> None:
        text = s.replacement or ""
        if numbered(s):
            n = self.replacements(s, p, v)
            self.df = ordered.prefix_sum(self.df, F.when(self.alive(), n).otherwise(0), "_last")
            seq = F.col("_last") - n
            total = self.count_before(i, n) if "${count}" in text else F.lit(0).cast("long")
            every = s.is_global
            tokens = template(text.replace("${seq}", "\x00").replace("${count}", "\x01"), p, s.backtracking(self.settings))

            def number(values: pd.Series, seqs: pd.Series, totals: pd.Series) -> pd.Series:
                def one(x: str, k: int) -> str:
                    done = 0

                    def make(m) -> str:  # noqa: ANN001
                        nonlocal done
                        done += 1
                        return expand(tokens, m).replace("\x00", str(k[0] + done)).replace("\x01", str(k[1] + done))

                    return substitute(p, x, make, every)[0]

                return pd.Series([None if x is None else one(x, (int(a), int(b))) for x, a, b in zip(values, seqs, totals)], dtype=object)

            new = F.pandas_udf(number, "string")(v, seq, total)
            self.measure(i, n, new != v)
            self.put(new)
            self.df = self.df.drop("_last")
            return
        if i in self.counting:
            self.df = self.df.withColumn(f"_k{i}", F.when(self.alive(), self.replacements(s, p, v)).otherwise(0).cast("long"))
        new = replaced(p, v, text, s.is_global, s.backtracking(self.settings))
        if self.stats:
            self.measure(i, self.replacements(s, p, v), new != v)
        self.put(new)

    def count_before(self, i: int, n: Column) -> Column:
        """How many matches the steps with numbers have replaced before this step comes to a line: those of all such steps on
        the lines before, and of the steps before this one on the line. What later steps replace is found by a run of its
        own, in which every number is 0; it raises where that isn't what they replace in the end."""
        each = [k for k, s in self.p.active if numbered(s)]
        if len(each) == 1:
            return F.col("_last") - n
        if any((s.mode or self.settings.mode) != "line" or s.scope or s.exclude_scopes for _, s in self.p.active):
            raise SpecError("${count} over several steps needs line mode")
        if "_before" not in self.df.columns:
            from dataclasses import replace

            plain = replace(self.p, steps=tuple(replace(s, replacement=s.replacement.replace("${count}", "0").replace("${seq}", "0")) if numbered(s) else s for s in self.p.steps))
            shadow = _Run(plain, self.lines, True, False)
            shadow.counting = frozenset(each)
            found = shadow.run().traced
            found = found.withColumns({f"_k{k}": F.coalesce(f"_k{k}", F.lit(0)) for k in each})
            sums = ordered.prefix_sum(found, sum((F.col(f"_k{k}") for k in each), F.lit(0)), "_all")
            counts = sums.select("source", "line_no", (F.col("_all") - sum((F.col(f"_k{k}") for k in each), F.lit(0))).alias("_before"), *[F.col(f"_k{k}").alias(f"_c{k}") for k in each])
            self.df = self.df.join(counts, ["source", "line_no"], "left")
        assumed = F.when(self.alive() & (n != F.col(f"_c{i}")), F.raise_error(F.lit("a later step matches the numbers that ${count} puts in"))).otherwise(F.lit(0).cast("long"))
        return F.col("_before") + sum((F.col(f"_c{k}") for k in each if k < i), F.lit(0).cast("long")) + assumed

    def replacements(self, s: Step, p: Pattern, v: Column) -> Column:
        """How many matches a step replaces in a line."""
        return count(p, v) if s.is_global else F.least(count(p, v), F.lit(1))

    def block(self, i: int, s: Step) -> None:
        v = F.col("value")
        start = s.compiled(s.start_pattern or s.pattern, self.settings)
        content = s.compiled(s.pattern, self.settings) if s.start_pattern and s.pattern else None
        rest = self.df.filter(~self.alive()) if self.trace else None
        df = self.df.filter(self.alive()) if self.trace else self.df
        inside, action = F.col("in_block"), s.action
        df = ordered.blocks(df, hits(start, v), hits(s.compiled(s.end_pattern, self.settings), v) if s.end_pattern else F.lit(False), ids=bool(content or action == "deduplicate" or s.block_context))
        name = action if isinstance(action, str) else next(iter(action)) if isinstance(action, dict) else None
        found = F.col("entering").cast("long")
        if name in ("collect_block", "deduplicate") and content is None:
            found = found + inside.cast("long")
        df = df.withColumn("_old", v)
        if s.block_context and (s.block_context.get("overlap_chars") or s.block_context.get("overlap_lines")):
            df = _overlap(df, s.block_context.get("overlap_chars"))
        if name == "mark_block" and content is None:
            df = df.withColumn("value", F.when(inside, F.concat(F.lit(action["mark_block"]["marker"]), v)).otherwise(v))
        elif name == "substitute_in_block" and content is None:
            a = action["substitute_in_block"]
            df = df.withColumn("value", F.when(inside, replaced(Pattern(a["pattern"]), v, a["replacement"], True)).otherwise(v))
        keep = F.lit(True)
        if content is not None:
            # The whole block is decided at its end; its end line isn't looked at. A block without an end is lost.
            decided = df.filter(inside).groupBy("source", "block_id").agg(F.max(hits(content, F.col("_old")) & ~F.col("exiting")).alias("_has"), F.max("exiting").alias("_ended"))
            df = df.join(decided, ["source", "block_id"], "left")
            has, ended = F.coalesce("_has", F.lit(False)), F.coalesce("_ended", F.lit(False))
            stays = ended & (has if name == "keep_block" else ~has if name == "drop_block" else F.lit(True))
            keep = inside & stays if name == "keep_block" else ~inside | stays
        elif name in ("keep_block", "drop_block"):
            keep = inside if name == "keep_block" else ~inside
        elif name == "deduplicate":
            # Equal blocks: by a digest of their lines in order, so no block is gathered.
            firsts = df.filter("entering").select("source", "block_id", F.col("line_no").alias("_from"))
            sig = df.filter(inside).join(firsts, ["source", "block_id"]).select("source", "block_id", F.xxhash64("value", F.col("line_no") - F.col("_from")).alias("h"))
            sig = sig.groupBy("source", "block_id").agg(F.bit_xor("h").alias("_x"), F.count("*").alias("_n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("_sum"))
            first = sig.groupBy("source", "_x", "_n", "_sum").agg(F.min("block_id").alias("block_id")).select("source", "block_id", F.lit(True).alias("_first"))
            df = df.join(first, ["source", "block_id"], "left")
            keep = ~inside | F.coalesce("_first", F.lit(False))
        self.df = df.withColumns({"_keep": keep, "_found": found})
        self.measure(i, F.col("_found"), ~F.col("_old").eqNullSafe(v))
        self.keep(F.col("_keep"), i)
        self.df = self.df.drop("_keep", "_found", "_old", "in_block", "entering", "exiting", "block_id", "_has", "_ended", "_first")
        if rest is not None:
            self.df = self.df.unionByName(rest, allowMissingColumns=True)

    def content_step(self, i: int, s: Step, mode: str) -> None:
        """A step on the whole content of each source (slurp), or on each of its paragraphs."""
        p = s.compiled(s.pattern, self.settings, multi=True)
        c = F.col("value")
        if s.type == "substitute":
            f = lambda x: replaced(p, x, s.replacement or "", s.is_global, s.backtracking(self.settings))
        elif s.type == "filter":
            f = {"keep_line": lambda x: F.when(hits(p, x), x).otherwise(""), "drop_line": lambda x: F.when(hits(p, x), "").otherwise(x), "drop_match": lambda x: replaced(p, x, "", True)}.get(s.action, lambda x: x)
        elif s.type == "extract":
            f = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(p.java), F.lit(0)), "\n")
        else:
            raise SpecError(f"step {i}: {s.type} steps are line by line")
        if p.nullable and mode == "paragraph":
            raise SpecError(f"step {i}: a paragraph pattern must match something")
        new = f(c) if mode == "slurp" else F.array_join(F.transform(F.split(c, "\n\n"), f), "\n\n")
        self.df = self.df.withColumn("value", new)

    def scoped_step(self, i: int, s: Step) -> None:
        """A step within syntax scopes of each source's text; sources in other languages (by their extension) stay as they are."""
        from .operators import syntax
        from .sources.lines import LANGUAGES

        p = s.compiled(s.pattern, self.settings)
        tokens = template(s.replacement or "", p, s.backtracking(self.settings))
        change = tf.action(s.transform, s.replacement, self.settings.allow_shell, self.settings.shell_timeout_secs) if s.type == "transform" else None
        for lang in s.languages or ("python",):
            syntax.ranges("", lang, list(s.scope), list(s.exclude_scopes))  # names are checked before anything runs

        def one(source: str, text: str) -> str:
            lang = LANGUAGES.get(source.rsplit(".", 1)[-1].lower())
            if lang is None or s.languages and lang not in s.languages:
                return text
            spans = syntax.ranges(text, lang, list(s.scope), list(s.exclude_scopes))
            if s.type == "substitute":
                return syntax.rewrite(text, p, spans, lambda m: expand(tokens, p.python.match(m[0]) or m))
            if s.type == "transform":
                return syntax.rewrite(text, p, spans, lambda m: change(m[0]))
            if s.type == "filter":
                rows = {text.count("\n", 0, m.start()) for m in syntax.in_scope(text, p, spans)}
                return "\n".join(x for n, x in enumerate(text.split("\n")) if (n in rows) == str(s.action).startswith("keep"))
            return text

        udf = F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object), "string")
        self.df = self.df.withColumn("value", udf(F.col("source").cast("string"), "value"))

    def slurped(self) -> None:
        """One row per source. A text must fit into a row, as in any engine that has it whole; ``max_slurp_size`` bounds it."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
        df = self.df.filter(self.alive()) if self.trace else self.df
        df = df.groupBy("source").agg(text.alias("value"))
        too_long = F.octet_length("value") > self.settings.max_slurp_size
        self.df = df.withColumn("value", F.when(too_long, F.raise_error(F.lit("a source is longer than max_slurp_size"))).otherwise(F.col("value")))

    def unslurped(self) -> None:
        pieces = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("value", r"\n\z", ""), "\n"))
        self.df = self.df.select("source", F.posexplode(pieces).alias("pos", "value")).select("source", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("value").alias("orig"), "value")
        if self.trace:
            self.df = self.df.withColumn("dropped_by", F.lit(None).cast("int"))

    def run(self) -> Result:
        steps = self.p.active
        whole = False
        self.line_limits()
        for i, s in steps:
            scoped = bool(s.scope or s.exclude_scopes)
            mode = "scope" if scoped else s.mode or self.settings.mode
            if (mode != "line") != whole:
                self.slurped() if mode != "line" else self.unslurped()
                whole = mode != "line"
            if scoped:
                self.scoped_step(i, s)
            elif whole:
                self.content_step(i, s, mode)
            else:
                self.line_step(i, s)
        if whole:
            self.unslurped()
        s = self.settings
        out = self.df.filter(self.alive()) if self.trace else self.df
        if self.bypass is not None:
            out = out.unionByName(self.bypass, allowMissingColumns=True)
        if s.context_before or s.context_after:
            final = out.select("source", "line_no", F.col("value").alias("_new"))
            every = self.original.join(final, ["source", "line_no"], "left")
            out = ordered.context(every, F.col("_new").isNotNull(), s.context_before, s.context_after).withColumn("value", F.coalesce("_new", "value"))
        if s.preserve_line_endings and "eol" in self.lines.columns:
            # A line that comes out under a number of the input ends as that line did; others end in a line feed.
            out = out.select("source", "line_no", "value").join(self.lines.select("source", F.col("line_no").cast("long").alias("line_no"), "eol"), ["source", "line_no"], "left").withColumn("eol", F.coalesce("eol", F.lit("LF")))
        errors = None
        for e in self.errors:
            errors = e if errors is None else errors.unionByName(e)
        kept = ["eol"] if s.preserve_line_endings and "eol" in self.lines.columns else []
        return Result(out.select("source", "line_no", "value", *kept), self.original, errors, self.df if self.trace else None, self._stats() if self.stats else None)

    def _stats(self) -> DataFrame:
        """(step_index, lines_in, lines_out, lines_dropped, matches, transformations)."""
        if not self.metrics:
            return self.df.sparkSession.createDataFrame([], "step_index int, lines_in long, lines_out long, lines_dropped long, matches long, transformations long")
        rows = F.explode(F.array(*[F.struct(F.lit(int(i)).alias("step_index"), F.col(f"_in{i}").alias("a"), F.col(f"_m{i}").alias("m"), F.col(f"_t{i}").alias("t"), (F.col("dropped_by") == int(i)).alias("d")) for i in self.metrics]))
        g = self.df.select(rows.alias("r")).select("r.*").groupBy("step_index")
        g = g.agg(F.sum("a").cast("long").alias("lines_in"), F.count_if("d").alias("lines_dropped"), F.sum("m").cast("long").alias("matches"), F.sum("t").cast("long").alias("transformations"))
        return g.select("step_index", "lines_in", (F.col("lines_in") - F.col("lines_dropped")).alias("lines_out"), "lines_dropped", "matches", "transformations")


def _overlap(df: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` characters of a block's end line (without ``n`` all of it) put before the next block's first line."""
    tail = df.filter("exiting").select("source", (F.col("block_id") + 1).alias("block_id"), (F.expr(f"right(value, {int(n)})") if n else F.col("value")).alias("_tail"))
    return df.join(tail, ["source", "block_id"], "left").withColumn("value", F.when(F.col("entering") & F.col("_tail").isNotNull(), F.concat("_tail", "value")).otherwise(F.col("value"))).drop("_tail")


def dedup_pieces(df: DataFrame) -> DataFrame:
    """Of all pieces that lines are rendered to (split at line feeds) the first of each; empty ones stay. Lines left without a piece go."""
    x = df.select("source", "line_no", "orig", F.posexplode(F.split("value", "\n")).alias("pos", "piece"))
    first = x.filter("piece <> ''").groupBy("source", "piece").agg(F.min_by(F.struct("line_no", "pos", "orig"), F.struct("line_no", "pos")).alias("f"))
    kept = first.select("source", "f.line_no", "f.orig", "f.pos", "piece").unionByName(x.filter("piece = ''"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "\n")
    return kept.groupBy("source", "line_no", "orig").agg(text.alias("value"))


def run(p: Pipeline, lines: DataFrame, trace: bool = False, stats: bool = False) -> Result:
    """Runs a pipeline over lines (source, line_no, value); state that reaches over lines is each source's own."""
    return _Run(p, lines, trace, stats).run()


def intermediates(p: Pipeline, lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """The lines after each enabled step."""
    from dataclasses import replace

    return [(i, run(replace(p, steps=p.steps[: i + 1]), lines).lines) for i, _ in p.active]


def why_dropped(p: Pipeline, lines: DataFrame) -> DataFrame:
    """(source, line_no, orig, dropped_by): each dropped line and the step that dropped it."""
    return run(p, lines, trace=True).traced.filter("dropped_by is not null").select("source", "line_no", "orig", "dropped_by")


def unused_steps(stats: DataFrame) -> DataFrame:
    return stats.filter("matches = 0 and transformations = 0").select("step_index")


def pipeline_stats(result: Result) -> DataFrame:
    """One row of a run with stats: (lines_processed, lines_output, lines_dropped, matches_found, transformations_applied, errors, success_rate)."""
    one = F.lit(1).alias("_one")
    steps = result.stats.agg(F.coalesce(F.sum("lines_dropped"), F.lit(0)).alias("lines_dropped"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches_found"), F.coalesce(F.sum("transformations"), F.lit(0)).alias("transformations_applied"))
    bad = result.errors.agg(F.count("*").alias("errors")) if result.errors is not None else steps.select(F.lit(0).cast("long").alias("errors"))
    row = result.original.agg(F.count("*").alias("lines_processed")).select("*", one)
    for part in (result.lines.agg(F.count("*").alias("lines_output")), steps, bad):  # each is one row
        row = row.join(part.select("*", one), "_one")
    n = F.col("lines_processed")
    return row.select("lines_processed", "lines_output", "lines_dropped", "matches_found", "transformations_applied", "errors", F.when(n > 0, (n - F.col("errors")) / n).otherwise(0.0).alias("success_rate"))


def why(p: Pipeline, lines: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The output lines that a pattern matches, and what each step did on the whole input (``Result.stats``)."""
    r = run(p, lines, stats=True)
    return r.lines.filter(hits(Pattern(pattern), F.col("value"))), r.stats


def inspection_totals(found: DataFrame) -> DataFrame:
    """(step_index, matches) from the rows of ``inspect``."""
    return found.groupBy("step_index").agg(F.count("*").alias("matches"))


def verification(matches_: int, transformations: int) -> str:
    """What a run amounts to."""
    return "transformations_applied" if transformations else "matches_found_no_transformations" if matches_ else "no_matches"


def source_stats(result: Result) -> DataFrame:
    """(source, lines_in, lines_out, changed), and of a run with stats the matches."""
    new = result.lines.select("source", "line_no", F.col("value").alias("_v"))
    j = result.original.join(new, ["source", "line_no"], "left")
    out = j.groupBy("source").agg(F.count("*").alias("lines_in"), F.count("_v").alias("lines_out"), F.count_if(F.col("_v") != F.col("value")).alias("changed"))
    if result.stats is None:
        return out
    each = [F.coalesce(c, F.lit(0)) for c in result.traced.columns if c.startswith("_m")]
    return out.join(result.traced.groupBy("source").agg(F.sum(sum(each, F.lit(0).cast("long"))).alias("matches")), "source", "left")


def totals(per_source: DataFrame, skipped: int = 0) -> DataFrame:
    """One row over the sources of a run with stats: (files_processed, files_matched, files_modified, files_skipped, total_matches, total_lines)."""
    return per_source.agg(
        F.count("*").alias("files_processed"), F.count_if(F.col("matches") > 0).alias("files_matched"), F.count_if((F.col("changed") > 0) | (F.col("lines_out") < F.col("lines_in"))).alias("files_modified"),
        F.lit(skipped).cast("long").alias("files_skipped"), F.coalesce(F.sum("matches"), F.lit(0)).alias("total_matches"), F.coalesce(F.sum("lines_in"), F.lit(0)).alias("total_lines"),
    )


def inspect(p: Pipeline, lines: DataFrame) -> DataFrame:
    """One row per match of each step's pattern on the original line: byte offsets, captures, and what it would become."""
    steps = [(i, s.compiled(s.start_pattern or s.pattern, p.settings), s) for i, s in p.active]

    def rows(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for source, n, text in zip(pdf["source"], pdf["line_no"], pdf["value"]):
                for i, pat, s in steps:
                    tokens = template(s.replacement, pat) if s.type == "substitute" and not pat.fixed else None
                    for m in matches(pat, text):
                        preview = expand(tokens, m) if tokens is not None else s.replacement if s.type == "substitute" else None
                        out.append((source, n, i, len(text[: m.start()].encode()), len(text[: m.end()].encode()), m[0], [m[k] for k in range(m.re.groups + 1)], preview))
            yield pd.DataFrame(out, columns=["source", "line_no", "step_index", "start_byte", "end_byte", "full_match", "captures", "replacement_preview"])

    kind = lines.schema["source"].dataType.simpleString()
    return lines.select("source", "line_no", "value").mapInPandas(rows, f"source {kind}, line_no long, step_index int, start_byte long, end_byte long, full_match string, captures array<string>, replacement_preview string")


# --- closing summary ---------------------------------------------------------------------------------------------------


def counters(lines: DataFrame, spec: Finalize) -> DataFrame:
    """One row: for each counter its count (lines that match, or distinct values), and the values it collects in order.

    Sums and distinct sets are combined per task before the shuffle; collected values are bounded by the counter.
    """
    def col(c: Counter) -> list[Column]:
        p = Pattern(c.pattern, frozenset(c.flags) - {"global"})
        hit = hits(p, F.col("value"))
        value = F.when(hit, F.regexp_extract("value", p.java, 1 if p.groups else 0))
        out = [(F.count_distinct(value) if c.deduplicate else F.count_if(hit)).alias(c.name)]
        return out

    wide = lines.agg(F.count("*").alias("lines"), *[x for c in spec.counters for x in col(c)])
    for c in spec.counters:
        if c.collect_values:
            # Both sides are one row.
            wide = wide.withColumn("_one", F.lit(1)).join(collected(lines, c).withColumn("_one", F.lit(1)), "_one").drop("_one")
    return wide


def collected(lines: DataFrame, c: Counter) -> DataFrame:
    """One row: the first values a counter collects, in the order of the lines (the first of each if it deduplicates)."""
    p = Pattern(c.pattern, frozenset(c.flags) - {"global"})
    v = lines.filter(hits(p, F.col("value"))).select("source", "line_no", F.regexp_extract("value", p.java, 1 if p.groups else 0).alias("v"))
    if c.deduplicate:
        v = v.groupBy("v").agg(F.min(F.struct("source", "line_no")).alias("k")).select("k.source", "k.line_no", "v")
    top = v.orderBy("source", "line_no").limit(c.max_collected_values)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "line_no", "v"))), lambda x: x["v"]).alias(f"{c.name}_values"))


def render_summary(row: dict, spec: Finalize, matches_: int = 0, transformations: int = 0) -> str:
    """The closing text, or JSON, from the row of ``counters``."""
    if spec.output_format == "json":
        out = {"lines_processed": row["lines"], "total_matches": matches_, "total_transformations": transformations, "counters": {}}
        for c in spec.counters:
            entry: dict = {"count": row[c.name]}
            if c.collect_values and row[f"{c.name}_values"]:
                entry["values"] = list(row[f"{c.name}_values"])
            if c.deduplicate:
                entry["unique"] = True
            out["counters"][c.name] = entry
        return json.dumps(out, ensure_ascii=False)
    text = spec.template or ""
    for c in spec.counters:
        text = text.replace(f"${{count:{c.name}}}", str(row[c.name]))
    for name, v in {"lines": row["lines"], "matches": matches_, "transformations": transformations, **{c.name: row[c.name] for c in spec.counters}}.items():
        text = text.replace(f"${{{name}}}", str(v))
    return text


def finalize(p: Pipeline, result: Result) -> str:
    """What a run ends with: the rendered summary of the definition's ``finalize`` over the input lines and, where shell
    commands are allowed, what its command says to the summary in JSON. The numbers of matches and changes are there for runs with stats."""
    f = p.finalize
    if f is None:
        return ""
    row = counters(result.original, f).first().asDict()
    total = pipeline_stats(result).first() if result.stats is not None else None
    n = (total.matches_found, total.transformations_applied) if total else (0, 0)
    out = render_summary(row, f, *n) if f.template is not None or f.output_format == "json" else ""
    if f.shell and p.settings.allow_shell:
        import subprocess
        from dataclasses import replace

        given = render_summary(row, replace(f, output_format="json"), *n)
        try:
            done = subprocess.run(["sh", "-c", f.shell], input=given, capture_output=True, text=True, timeout=p.settings.shell_timeout_secs)
            said = done.stdout if done.returncode == 0 else f"[finalize shell error: {done.stderr.strip()}]"
        except (OSError, subprocess.SubprocessError) as e:
            said = f"[finalize shell error: {e}]"
        out = "\n".join(x.rstrip("\n") for x in (out, said) if x)
    return out


__all__ = ["Result", "finalize", "inspection_totals", "pipeline_stats", "totals", "why", "collected", "counters", "extracted", "hits", "inspect", "intermediates", "render_summary", "replaced", "run", "source_stats", "transformed", "unused_steps", "verification", "why_dropped"]
