"""Where lines go: text, edited files, envelopes, annotations, diffs."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def write_text(lines: DataFrame, path: str) -> None:
    """One text file per partition, in the order of source and line; rows with line feeds become several lines."""
    lines.repartitionByRange("source", "line_no").sortWithinPartitions("source", "line_no").select("value").write.text(path)


def as_documents(lines: DataFrame, final_newline: bool = True) -> DataFrame:
    """(source, text): the lines of each source in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    return lines.groupBy("source").agg((F.concat(text, F.lit("\n")) if final_newline else text).alias("text"))


def edit_in_place(documents: DataFrame, backup: str | None = None) -> DataFrame:
    """Replaces local files (source, text) on the machine that runs the task, each by a temporary file and a rename; (source, bytes)."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for source, text in zip(pdf["source"], pdf["text"]):
                path = source.removeprefix("file://")
                if backup:
                    shutil.copy2(path, path + backup)
                with open(f"{path}.tmp", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(f"{path}.tmp", path)
                out.append((source, len(text.encode())))
            yield pd.DataFrame(out, columns=["source", "bytes"])

    return documents.select("source", "text").mapInPandas(run, "source string, bytes long")


def commit_all(texts: dict[str, str]) -> None:
    """Writes several files or none: all are staged first, and what was renamed is put back if a later one fails."""
    staged, done = {}, []
    try:
        for path, text in texts.items():
            with open(f"{path}.stage", "w", encoding="utf-8", newline="") as f:
                f.write(text)
            staged[path] = f"{path}.stage"
        for path, stage in staged.items():
            if os.path.exists(path):
                os.replace(path, f"{path}.undo")
                done.append((path, True))
            else:
                done.append((path, False))
            os.replace(stage, path)
    except OSError:
        for path, existed in reversed(done):
            if existed:
                os.replace(f"{path}.undo", path)
            elif os.path.exists(path):
                os.remove(path)
        raise
    finally:
        for p in [*staged.values(), *(f"{p}.undo" for p, _ in done)]:
            if os.path.exists(p):
                os.remove(p)


def envelope(mode: str, data: object, version: str = "0.1.0") -> str:
    return json.dumps({"metadata": {"schema_version": SCHEMA_VERSION, "mode": mode, "tool_version": version}, "data": data}, ensure_ascii=False)


def jsonl(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def file_results(results: DataFrame) -> DataFrame:
    """A JSON line for each file result, nulls written out, and one with their totals."""
    each = results.select(F.to_json(F.struct("path", "matches_found", "lines_processed", "modified", "error"), {"ignoreNullFields": "false"}).alias("value"))
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = results.agg(F.count("*").alias("files_processed"), F.count_if(F.col("matches_found") > 0).alias("files_matched"), F.count_if("modified").alias("files_modified"), sum_of("matches_found").alias("total_matches"), sum_of("lines_processed").alias("total_lines"))
    return each.unionByName(total.select(F.to_json(F.struct("*")).alias("value")))


# The kinds of envelopes.
MODES = ("processing", "count", "multi_file", "files_with_matches", "files_without_matches", "performance", "error", "verify", "explain")


def processing(stats: dict, errors: list[dict] = ()) -> str:
    """The envelope of a run, from the row of ``engine.pipeline_stats``."""
    return envelope("processing", {k: stats[k] for k in ("lines_processed", "lines_output", "matches_found", "transformations_applied", "success_rate")} | {"errors": list(errors)})


def count(stats: dict) -> str:
    return envelope("count", {"matches": stats["matches_found"], "lines_processed": stats["lines_processed"]})


def multi_file(totals: dict, files: list[dict] = (), errors: list[str] = ()) -> str:
    """The envelope of a run over files, from the row of ``engine.totals`` and rows of file results."""
    return envelope("multi_file", {**totals, "files": list(files), "errors": list(errors)})


def file_list(paths: list[str], mode: str) -> str:
    return envelope(mode, {"files": list(paths), "count": len(paths)})


def error(kind: str, message: str, code: int) -> str:
    return envelope("error", {"error_type": kind, "message": message, "exit_code": code})


def verify(status: str, stats: dict) -> str:
    return envelope("verify", {"status": status, "matches": stats["matches_found"], "transformations": stats["transformations_applied"]})


def explained(steps: list[str]) -> str:
    return envelope("explain", {"steps": steps})


def annotations(lines: DataFrame, level: str = "warning") -> DataFrame:
    """``::level file=...,line=N::text`` for each line."""
    return lines.select("source", "line_no", F.format_string(f"::{level} file=%s,line=%d::%s", "source", "line_no", "value").alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number among the lines that came out, ``N: line``."""
    from ..operators.ordered import prefix_sum

    return prefix_sum(lines, F.lit(1), "_n").select("source", "line_no", F.concat_ws(": ", F.col("_n").cast("string"), "value").alias("value"))


def changes(original: DataFrame, lines: DataFrame) -> DataFrame:
    """(source, line_no, old, new): lines that changed (new) or went (null)."""
    new = lines.select("source", "line_no", F.col("value").alias("new"))
    return original.join(new, ["source", "line_no"], "left").filter(~F.col("value").eqNullSafe(F.col("new"))).select("source", "line_no", F.col("value").alias("old"), "new")


def unified_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, diff) of (source, text) frames, for the sources whose texts differ."""
    import difflib

    @F.pandas_udf("string")
    def diff(s, a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(["".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), f"a/{n}", f"b/{n}")) for n, x, y in zip(s, a, b)], dtype=object)

    j = before.select("source", F.col("text").alias("_a")).join(after.select("source", F.col("text").alias("_b")), "source").filter("_a <> _b")
    return j.select("source", diff(F.col("source").cast("string"), "_a", "_b").alias("diff"))


def match_counts(lines: DataFrame, hit: Column) -> DataFrame:
    """(source, matches): how many lines match, 0 included."""
    return lines.groupBy("source").agg(F.count_if(hit).alias("matches"))
