"""Log lines into entries: mining of frequent position-words, header parsing, entry extents and instants.

Stages
1. ``parse_lines``: one scan turns lines into small header rows; the texts themselves are never shuffled. Of a line that begins
   with a time it keeps the head, the few tokens behind the time.
2. ``mine_templates``: frequent position-words. Counts of (position, word) over all heads, combined per task before the shuffle,
   give the constants; a head's template is its skeleton with its constants, and which of its tokens are level and component
   follows from them. ``with_fields`` assigns the tokens; heads without a template (outliers) go through fallback rules.
3. ``entry_extents`` / ``entry_instants``: order within a file matters. Every file is split into runs of ``CHUNK`` line
   numbers, so a file that holds a third of all rows is spread over many tasks; what a chunk needs from those before it
   (last brace, next start, last instant) is carried over a table of one row per chunk.

Defined results: lines whose text is null, empty or blank, and rows with a null path or line number, open nothing. A
(path, line_number) that comes again counts once. A table without rows gives no entries. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import BRACE, EXTENT, HEAD, LEVELS, MEMBER, NONE, START, HeaderParser, by_rules, clean, head_of, message_of, skeleton_of, slots_of
from ..functions.timestamps import with_local, with_utc
from ..plans import cut

CHUNK = 50_000
SUPPORT = 0.0005
#: Up to so many log files their paths are given to all tasks, so that lines of other files are left out before they are read;
#: with more, the header rows are joined instead.
FILES = 200_000

_HEADER = pa.schema(
    [("path", pa.string()), ("line_number", pa.int64()), ("line_id", pa.int64()), ("what", pa.int8()), ("level", pa.string()), ("component", pa.string()), ("kind", pa.int8()), ("us", pa.int64()), ("own", pa.bool_())]
)
_HEADER_DDL = "path string, line_number bigint, line_id bigint, what tinyint, level string, component string, kind tinyint, us bigint, own boolean"


def lines_of(line_matches: DataFrame) -> DataFrame:
    """(path, line_number, line_id, text, own): the original, or the transformed text where the original is lost (own false)."""
    return line_matches.select(
        "path", F.col("line_number").cast("long").alias("line_number"), F.col("line_id").cast("long").alias("line_id"), F.coalesce("original_line", "transformed_line").alias("text"), F.col("original_line").isNotNull().alias("own")
    ).filter("path is not null and line_number is not null and text is not null")


def parse_lines(lines: DataFrame, heads: bool = True) -> DataFrame:
    """A row for each line that opens an entry or holds a field or brace of one, and one for the last line of each file in each batch.

    With ``heads`` also what stands behind the time of lines that begin with one: ``head``, its first tokens, and ``skeleton``, their forms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = HeaderParser().parse
        for batch in batches:
            path, number, line_id, text, own = (batch.column(i) for i in range(5))
            what, level, name, kind, us, keep, head, skeleton = [], [], [], [], [], [], [], []
            paths, numbers = path.to_pylist(), number.to_pylist()
            last: dict[str, tuple[int, int]] = {}
            for i, t in enumerate(text.to_pylist()):
                p, n = paths[i], numbers[i]
                if p not in last or last[p][0] < n:
                    last[p] = (n, i)
                if (got := parse(t))[0]:
                    keep.append(i)
                    what.append(got[0]), level.append(got[1]), name.append(got[2]), kind.append(got[3]), us.append(got[4])
                    if heads:
                        tokens = head_of(clean(t), got[5]) if got[0] == START and got[1] is None else None
                        head.append(tokens), skeleton.append(None if tokens is None else skeleton_of(tokens))
            ends = set(last_i for _, last_i in last.values()).difference(keep)
            keep += ends
            n = len(ends)
            take = pa.array(keep, pa.int32())
            cols = [path.take(take), number.take(take), line_id.take(take), pa.array(what + [EXTENT] * n, pa.int8()), pa.array(level + [None] * n, pa.string()), pa.array(name + [None] * n, pa.string()), pa.array(kind + [0] * n, pa.int8()), pa.array(us + [None] * n, pa.int64()), own.take(take)]
            if heads:
                cols += [pa.array(head + [None] * n, pa.list_(pa.string())), pa.array(skeleton + [None] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*_HEADER.names, "head", "skeleton"][: len(cols)])

    return lines.select("path", "line_number", "line_id", "text", "own").mapInArrow(run, _HEADER_DDL + (", head array<string>, skeleton string" if heads else ""))


def _masked(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+", "0")


def mine_templates(headers: DataFrame, support: float = SUPPORT) -> dict[str, tuple[int, int]]:
    """skeleton -> (token that is the level, token that is the component), from the frequent words of the heads.

    Counts of (position, word) say which words are constants (in ``support`` of all heads: at most 5 / support of them), and
    counts of constants by position in each skeleton what the tokens are. There are at most (number of forms + 1) ** 5
    skeletons; those of fewer heads than ``support`` form no template.
    """
    heads = headers.filter("skeleton is not null and skeleton <> ''")
    pairs = heads.select(F.posexplode(F.transform("head", _masked)).alias("at", "word")).groupBy("at", "word").agg(F.count("*").alias("n"))
    total = heads.count()
    floor = max(total * support, 2)
    words: dict[int, list[str]] = {}
    for r in pairs.filter(F.col("n") >= floor).select("at", "word").collect():
        words.setdefault(r["at"], []).append(r.word)
    hit = lambda k: F.coalesce(_masked(F.get("head", F.lit(k))).isin(words[k]), F.lit(False)) if words.get(k) else F.lit(False)
    votes = heads.groupBy("skeleton").agg(F.count("*").alias("n"), *[F.count_if(hit(k)).alias(f"c{k}") for k in range(HEAD)])
    return {r.skeleton: slots_of(r.skeleton, [r[f"c{k}"] / r.n for k in range(HEAD)]) for r in votes.filter(F.col("n") >= floor).collect()}


def with_fields(headers: DataFrame, templates: dict[str, tuple[int, int]]) -> DataFrame:
    """Level and component of the lines with heads: by the slots of their templates, those of outliers by the fallback rules."""
    known = headers.sparkSession.createDataFrame([(k, *v) for k, v in templates.items()], "skeleton string, _level int, _name int")
    rows = headers.join(F.broadcast(known), "skeleton", "left")
    fixed = [c for c in headers.columns if c not in ("level", "component", "head", "skeleton")]
    level, name = F.get("head", "_level"), F.get("head", "_name")
    words = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    bare = F.lower(F.regexp_replace(F.regexp_replace(level, r"[\[\](){}<>:,; ]+$", ""), r"^(?:.*\.(?=[^.]+$)|[\[\](){}<>:,; ]+)", ""))
    both = F.col("_level") == F.col("_name")
    title = F.when(both, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.regexp_replace(name, r"(?:\[[0-9]+\])?:?$", ""))
    has = F.col("skeleton").isNotNull()
    settled = rows.filter(~has | F.col("_level").isNotNull()).select(
        *fixed, F.when(has, F.coalesce(F.when(F.col("_level") >= 0, words[bare]), F.lit(""))).otherwise(F.col("level")).alias("level"), F.when(has, F.coalesce(F.when(F.col("_name") >= 0, title), F.lit(""))).otherwise(F.col("component")).alias("component")
    )

    def outliers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [by_rules(h or []) for h in b.column(len(fixed)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fixed)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], [*fixed, "level", "component"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in headers.schema if f.name in fixed) + ", level string, component string"
    rest = rows.filter(has & F.col("_level").isNull()).select(*fixed, "head").mapInArrow(outliers, schema)
    return settled.unionByName(rest)


def _chunked(df: DataFrame, by: str = "line_number") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(by) / CHUNK))


def _carried(df: DataFrame, value: str, order: str, forward: bool = True) -> DataFrame:
    """(path, chunk, carried): the last non-null ``value`` of the chunks before, or the first one of those after."""
    side = F.max_by if forward else F.min_by
    per = df.filter(F.col(value).isNotNull()).groupBy("path", "chunk").agg(side(value, order).alias("_v"))
    every = df.select("path", "chunk").distinct().join(per, ["path", "chunk"], "left")
    w = Window.partitionBy("path").orderBy(F.col("chunk") if forward else F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return every.select("path", "chunk", F.last("_v", True).over(w).alias("carried"))


def with_owner(headers: DataFrame) -> DataFrame:
    """Adds ``owner``: the first line of the entry that a row opens or belongs to; member lines outside of a bare brace are dropped."""
    rows = _chunked(headers.filter(F.col("what") != EXTENT)).repartition("path", "chunk")
    opener = F.when(F.col("what") != MEMBER, F.struct("line_number", "what"))
    rows = rows.withColumn("_opener", opener)
    carry = _carried(rows, "_opener", "line_number")
    w = Window.partitionBy("path", "chunk").orderBy("line_number", "line_id")
    rows = rows.withColumn("_opener", F.last("_opener", True).over(w)).join(carry, ["path", "chunk"], "left")
    opener = F.coalesce("_opener", "carried")
    owner = F.when(F.col("what").isin(START, BRACE), F.col("line_number")).when((F.col("what") == MEMBER) & (opener["what"] == BRACE), opener["line_number"])
    return rows.withColumn("owner", owner).drop("_opener", "carried").filter("owner is not null")


def entry_extents(headers: DataFrame) -> DataFrame:
    """(path, first_line, last_line, level, component), one row per entry; it ends at the number before the next entry's first."""
    rows = with_owner(headers)
    plain = rows.filter(F.col("what") == START).select("path", F.col("owner").alias("first_line"), "level", "component")
    spread = rows.filter(F.col("what") != START).groupBy("path", F.col("owner").alias("first_line")).agg(F.max("level").alias("level"), F.max("component").alias("component"), F.max(F.col("level").isNotNull() | (F.col("kind") > 0)).alias("is_entry")).filter("is_entry").drop("is_entry")
    # A line that comes again under another id has the same text: one of its rows stands for all.
    entries = cut(_chunked(plain.unionByName(spread), "first_line").groupBy("path", "chunk", "first_line").agg(F.max("level").alias("level"), F.max("component").alias("component")))
    ends = headers.groupBy("path").agg(F.max("line_number").alias("end"))
    next_chunk = _carried(entries, "first_line", "first_line", forward=False)
    bounds = next_chunk.join(ends, "path").select("path", "chunk", F.coalesce(F.col("carried") - 1, "end").alias("bound"))
    w = Window.partitionBy("path", "chunk").orderBy("first_line")
    return (
        entries.withColumn("_next", F.lead("first_line").over(w))
        .join(bounds, ["path", "chunk"])
        .select("path", "first_line", F.coalesce(F.col("_next") - 1, "bound").alias("last_line"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("component", F.lit("")).alias("component"))
    )


def entry_instants(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(line_id, path, line_number, ts_us, own) for each row that holds an entry's own timestamp.

    files: (path, zone, first_day). A local time that occurs twice is the earlier instant unless that precedes the file's
    previous timestamp. Within an unbroken run of such times of one change of clocks, the first one that steps back is
    late, and so are all after it; that makes the choice a running maximum instead of a recursion.
    """
    rows = with_owner(headers).filter("kind > 0 and us is not null").join(files, "path")
    rows = with_local(rows, "kind", "us", "zone", "first_day").filter("local_us is not null")
    rows = with_utc(cut(rows.select("path", "chunk", "line_number", "line_id", "own", "local_us", "utc_zone")))
    rows = rows.select("path", "chunk", "line_number", "line_id", "own", F.col("early_us").alias("early"), F.col("late_us").alias("late"))
    w = Window.partitionBy("path", "chunk").orderBy("line_number", "line_id")
    here = F.struct("early", "late")
    rows = rows.withColumn("_at", F.struct("line_number", "line_id"))
    before = _carried(rows.withColumn("_v0", here), "_v0", "_at")
    rows = rows.withColumn("_prev", F.lag(here).over(w)).join(before, ["path", "chunk"], "left")
    prev = F.coalesce("_prev", "carried")
    day = F.lit(86_400_000_000)
    same = F.col("late").isNotNull() & prev["late"].isNotNull() & (F.abs(F.col("early") - prev["early"]) < day)
    rows = rows.withColumns({"_run": F.coalesce(same, F.lit(False)), "_back": F.coalesce(F.col("late").isNotNull() & (F.col("early") < prev["early"]), F.lit(False))}).drop("_prev", "carried")
    rows = rows.withColumn("_part", F.sum((~F.col("_run")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_late", F.max("_back").over(Window.partitionBy("path", "chunk", "_part").orderBy("line_number", "line_id").rowsBetween(Window.unboundedPreceding, 0)))
    # A run that goes on from the chunk before: late if it was late there.
    ends = rows.groupBy("path", "chunk").agg(F.max_by(F.struct("_late", "_part"), "_at").alias("e"))
    c = Window.partitionBy("path").orderBy("chunk")
    ends = ends.withColumn("_g", F.sum((F.col("e._part") != 0).cast("int")).over(c.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_s", F.max("e._late").over(Window.partitionBy("path", "_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))
    carry = ends.select("path", "chunk", F.lag("_s").over(c).alias("_carry"))
    late = F.col("_late") | ((F.col("_part") == 0) & F.coalesce("_carry", F.lit(False)))
    return rows.join(carry, ["path", "chunk"], "left").select("line_id", "path", "line_number", F.when(late, F.col("late")).otherwise(F.col("early")).alias("ts_us"), "own")


def headers_of(line_matches: DataFrame, source_files: DataFrame, heads: bool = True) -> tuple[DataFrame, DataFrame]:
    """The header rows of all log files, written once, and the log files (path, zone, first_day)."""
    files = source_files.filter("language = 'log' and path is not null").select("path", "zone", "first_day").dropDuplicates(["path"])
    lines, paths = lines_of(line_matches), files.select("path")
    if files.count() <= FILES:
        return cut(parse_lines(lines.join(F.broadcast(paths), "path", "left_semi"), heads)), files
    return cut(parse_lines(lines, heads).join(paths, "path", "left_semi")), files


def find_entries(line_matches: DataFrame, source_files: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The entries of log files: (path, first_line, last_line, level, component)."""
    headers, _ = headers_of(line_matches, source_files)
    return entry_extents(with_fields(headers, mine_templates(headers, support)))


def find_instants(line_matches: DataFrame, source_files: DataFrame) -> DataFrame:
    """(line_id, ts_us) of the rows of log files whose original holds an entry's own timestamp."""
    headers, files = headers_of(line_matches, source_files, heads=False)
    return entry_instants(headers, files).filter("own").select("line_id", "ts_us")


#: Lines of an entry that one row's message holds; a longer entry goes on in further rows.
PART = 1000


def full_entries(line_matches: DataFrame, source_files: DataFrame) -> DataFrame:
    """(path, first_line, last_line, level, component, ts_us, part, message): the entries with their instants and whole messages.

    The lines of an entry come together by (path, entry, part), parts of ``PART`` lines, so an entry of any length is never
    one task's group.
    """
    headers, files = headers_of(line_matches, source_files)
    entries = cut(entry_extents(with_fields(headers, mine_templates(headers))))
    owner = with_owner(headers).select("path", "line_number", "owner")
    instants = entry_instants(headers, files).groupBy("path", "line_number").agg(F.max("ts_us").alias("ts_us")).join(owner.dropDuplicates(["path", "line_number"]), ["path", "line_number"])
    instants = instants.groupBy("path", F.col("owner").alias("first_line")).agg(F.max("ts_us").alias("ts_us"))
    lines = lines_of(line_matches).join(files.select("path"), "path", "left_semi")
    lines = _chunked(lines.groupBy("path", "line_number").agg(F.max("text").alias("text"))).repartition("path", "chunk")
    starts = _chunked(entries.select("path", F.col("first_line").alias("line_number")))
    lines = lines.join(starts.select("path", "chunk", "line_number", F.col("line_number").alias("start")), ["path", "chunk", "line_number"], "left")
    carry = _carried(starts.withColumn("start", F.col("line_number")).unionByName(lines.select("path", "line_number", "chunk", F.lit(None).cast("long").alias("start"))), "start", "line_number")
    w = Window.partitionBy("path", "chunk").orderBy("line_number")
    lines = lines.withColumn("first_line", F.last("start", True).over(w)).join(carry, ["path", "chunk"], "left")
    lines = lines.withColumn("first_line", F.coalesce("first_line", "carried")).filter("first_line is not null")
    parts = lines.groupBy("path", "first_line", F.floor((F.col("line_number") - F.col("first_line")) / PART).alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_number", "text"))).alias("l"))

    @F.pandas_udf("string")
    def message(texts, part, level, component):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([message_of(list(t), a, b) if p == 0 else "\n".join(map(clean, t)) for t, p, a, b in zip(texts, part, level, component)], dtype=object)

    text = message(F.transform("l", lambda x: x["text"]), "part", "level", "component").alias("message")
    return entries.join(parts, ["path", "first_line"]).select("path", "first_line", "last_line", "level", "component", "part", text).join(instants, ["path", "first_line"], "left").select("path", "first_line", "last_line", "level", "component", "ts_us", "part", "message")


__all__ = ["BRACE", "MEMBER", "NONE", "START", "entry_extents", "entry_instants", "find_entries", "find_instants", "full_entries", "headers_of", "lines_of", "mine_templates", "parse_lines", "with_fields", "with_owner"]
