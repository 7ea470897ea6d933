"""Lines: (source, line_no, value) from files or from a text column."""

from __future__ import annotations

import fnmatch
import io
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import cut

# Languages by file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml"}


def split_lines(df: DataFrame, source: str, text: str) -> DataFrame:
    """The lines of a text column, numbered from 1. They end at line feeds only; ends of lines are cut off, and an empty piece
    after the last line feed is no line. Null texts have no lines."""
    c = F.col(text)
    pieces = F.split(F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.char_length(c) - 1)).otherwise(c), "\n")
    return df.filter(c.isNotNull() & (c != "")).select(F.col(source).alias("source"), F.posexplode(pieces).alias("pos", "value")).select("source", (F.col("pos") + 1).cast("long").alias("line_no"), F.regexp_replace("value", r"[\r\n]+\z", "").alias("value"))


def read_whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(source, text): one row per file, invalid bytes as U+FFFD."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.make_valid_utf8("value").alias("text"))


def read_lines(spark: SparkSession, paths: list[str] | str, keep_ends: bool = False) -> DataFrame:
    """The lines of files (source, line_no, value); with ``keep_ends`` also ``eol``: LF, CRLF or NONE.

    A large file is many tasks: each split counts its lines, and a line's number is its place in its split plus the lines of
    the splits before, which come from a table of one row per split. Invalid bytes become U+FFFD.
    """
    m = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(paths).select(m["file_path"].alias("source"), m["file_block_start"].alias("_b"), m["file_size"].alias("_size"), F.monotonically_increasing_id().alias("_i"), "value")
    per = raw.groupBy("source", "_b").agg(F.min("_i").alias("_min"), F.count("*").alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.first("_size").alias("_size"))
    out = raw.drop("_size").join(_numbered(per), ["source", "_b"]).withColumn("line_no", F.col("_before") + F.col("_i") - F.col("_min") + 1)
    value = F.regexp_replace(F.make_valid_utf8("value"), r"\r+\z", "").alias("value")
    if not keep_ends:
        return out.select("source", "line_no", value)
    # The last line has no end if the bytes of all lines with one each are one more than the file has (a byte order mark has three).
    open_end = (F.col("line_no") == F.col("_lines")) & (F.pmod(F.col("_size") - F.col("_all_bytes"), F.lit(3)) == 2)
    eol = F.when(open_end, "NONE").when(F.col("value").endswith("\r"), "CRLF").otherwise("LF")
    return out.select("source", "line_no", value, eol.alias("eol"))


def _numbered(per: DataFrame) -> DataFrame:
    """Adds to the rows of splits (source, _b, _n) how many lines are in those before, and in the whole file."""
    w = Window.partitionBy("source")
    out = per.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_lines", F.sum("_n").over(w))
    return out.withColumn("_all_bytes", F.sum("_bytes").over(w)) if "_bytes" in per.columns else out


def glob_regex(pattern: str) -> str:
    return fnmatch.translate(pattern)


def _ignore_rule(line: str, base: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern of paths, whether it takes back, whether it is for folders only) of a line of an ignore file in ``base``."""
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    back, text = text.startswith("!"), text.removeprefix("!")
    folder, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 1 :]:
            end = text.index("]", i + 1)
            out, i = out + text[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    return re.compile(re.escape(base.rstrip("/")) + "/" + ("" if anchored else "(?:.*/)?") + out), back, folder


def discover(paths: list[str], include: list[str] = (), exclude: list[str] = (), depth: int | None = None, hidden: bool = False, ignore_files: tuple[str, ...] = (".gitignore", ".ignore")) -> tuple[list[str], list[str]]:
    """(files, errors): files under the paths, in order, without following links; any include must fit, no exclude may.

    Ignore files hold for their folder and all below; later rules, and those of deeper folders, come after earlier ones, and
    ``!`` takes back.
    """
    found, errors = [], []

    def wanted(path: str) -> bool:
        names = (path, os.path.basename(path))
        return (not include or any(fnmatch.fnmatch(n, g) for n in names for g in include)) and not any(fnmatch.fnmatch(n, g) for n in names for g in exclude)

    for p in paths:
        if os.path.isfile(p):
            found.append(p)
        elif not os.path.isdir(p):
            errors.append(f"{p}: no such file or directory")
        else:
            held: dict[str, list] = {}
            for at, folders, files in os.walk(p, onerror=lambda e: errors.append(str(e))):
                rules = list(held.get(os.path.dirname(at), [])) if at != p else []
                for name in ignore_files:
                    if name in files:
                        with open(os.path.join(at, name)) as f:
                            rules += [r for x in f if (r := _ignore_rule(x.rstrip("\n"), at))]
                held[at] = rules

                def skip(n: str, is_folder: bool, at=at, rules=rules) -> bool:
                    if not hidden and n.startswith("."):
                        return True
                    out = False
                    for rx, back, folder in rules:
                        if (is_folder or not folder) and rx.fullmatch(f"{at.rstrip('/')}/{n}"):
                            out = not back
                    return out

                level = os.path.relpath(at, p).count(os.sep) + (at != p)
                folders[:] = sorted(d for d in folders if not skip(d, True) and not os.path.islink(os.path.join(at, d)) and (depth is None or level + 1 < depth))
                found += [f for n in sorted(files) if not skip(n, False) and not os.path.islink(f := os.path.join(at, n)) and wanted(f)]
    return list(dict.fromkeys(found)), errors


def _open(source: str):  # noqa: ANN202
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(source if "://" in source else "file://" + os.path.abspath(source))
    return system.open_input_file(path)


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source) of the files that have no NUL byte in their first 8 KiB; no more of them is read."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            keep = []
            for source in pdf["source"]:
                with _open(source) as f:
                    keep.append(b"\x00" not in f.read(8192))
            yield pdf[keep]

    files = spark.createDataFrame([(p,) for p in paths], "source string")
    return files.repartition(max(1, min(len(paths), 1000))).mapInPandas(run, "source string")


#: Bytes of a file that one task reads.
RANGE = 64 << 20


def read_from_offsets(spark: SparkSession, paths: list[str], state: DataFrame, size: int | None = None) -> DataFrame:
    """Lines behind the stored (source, byte_offset, line_number) of each file; files without a state from the start.

    Only what is behind the offsets is read, in ranges of ``size`` bytes; a line belongs to the range that it begins in.
    """
    size = size or RANGE
    files = spark.createDataFrame([(p,) for p in paths], "source string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731 - a local file has several names
    known = state.select(plain("source").alias("_key"), F.col("byte_offset").cast("long").alias("byte_offset"), F.col("line_number").cast("long").alias("line_number"))
    start = files.withColumn("_key", plain("source")).join(known, "_key", "left").select("source", F.coalesce("byte_offset", F.lit(0)).alias("_at"), F.coalesce("line_number", F.lit(0)).alias("_line"))

    def ranges(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for source, at, line in zip(pdf["source"], pdf["_at"], pdf["_line"]):
                with _open(source) as f:
                    out += [(source, at, line, b) for b in range(int(at), f.size(), size)]
            yield pd.DataFrame(out, columns=["source", "_at", "_line", "_b"])

    parts = cut(start.mapInPandas(ranges, "source string, _at long, _line long, _b long")).repartition("source", "_b")

    def lines(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for source, at, line, b in zip(pdf["source"], pdf["_at"], pdf["_line"], pdf["_b"]):
                rows = []
                with _open(source) as raw_file, io.BufferedReader(raw_file) as f:
                    end = min(b + size, raw_file.size())
                    f.seek(b if b == at else b - 1)
                    if b != at:
                        f.readline()  # the end of a line of the range before
                    while f.tell() < end:
                        rows.append(f.readline().decode("utf-8", "replace").rstrip("\r\n"))
                if rows:
                    yield pd.DataFrame({"source": source, "_line": line, "_b": b, "_i": range(len(rows)), "value": rows}, columns=["source", "_line", "_b", "_i", "value"])

    raw = cut(parts.mapInPandas(lines, "source string, _line long, _b long, _i long, value string"))
    per = _numbered(raw.groupBy("source", "_b").agg(F.count("*").alias("_n"))).select("source", "_b", "_before")
    return raw.join(per, ["source", "_b"]).select("source", (F.col("_line") + F.col("_before") + F.col("_i") + 1).alias("line_no"), "value")


def hunks(diff_text: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) of the new side of each hunk of a unified diff."""
    out, name = [], ""
    for line in diff_text.splitlines():
        if line.startswith("+++ "):
            name = line[4:].removeprefix("b/").split("\t")[0]
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
            n = int(m[2]) if m[2] is not None else 1
            if n:
                out.append((name, int(m[1]), int(m[1]) + n - 1))
    return out


def within_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines inside any of (source, first, last); ranges are joined by source, then compared."""
    hit = lines.join(ranges.select(F.col("source").alias("_s"), "first", "last"), (F.col("source") == F.col("_s")) & F.col("line_no").between(F.col("first"), F.col("last")), "left_semi")
    return hit


def changed_files(folder: str, ref: str = "HEAD") -> list[str]:
    """Files that differ from a git reference."""
    import subprocess

    done = subprocess.run(["git", "-C", folder, "diff", "--name-only", ref], capture_output=True, text=True, check=True)
    return [os.path.join(folder, x) for x in done.stdout.splitlines() if x]
