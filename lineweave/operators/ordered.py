"""Operators on the order of lines within a source, split into chunks of line numbers.

A source that holds a third of all rows would be one task under a window per source. Here every window is per (source, chunk),
and what a chunk needs from those before it comes from a table of one row per chunk. Lines whose source is null have no order and
are dropped here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000
KEYS = ("source", "chunk")


def chunked(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("line_no") / CHUNK))


def _window(frame: bool = True) -> Window:
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    return w.rowsBetween(Window.unboundedPreceding, 0) if frame else w


def _before() -> Window:
    return Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def prefix_sum(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the source's lines up to and with this one."""
    df = chunked(df).withColumn("_v", F.coalesce(value.cast("long"), F.lit(0)))
    per = df.groupBy(*KEYS).agg(F.sum("_v").alias("_s"))
    before = per.select(*KEYS, F.coalesce(F.sum("_s").over(_before()), F.lit(0)).alias("_b"))
    return df.withColumn("_in", F.sum("_v").over(_window())).join(before, list(KEYS)).withColumn(name, F.col("_in") + F.col("_b")).drop("_v", "_in", "_b", "chunk")


def first_seen(df: DataFrame, key: Column) -> DataFrame:
    """The first line of each key in each source; keys are combined per task before the shuffle, so a frequent one is no burden."""
    df = df.withColumn("_k", key)
    first = df.groupBy("source", "_k").agg(F.min("line_no").alias("_first"))
    return df.join(first.withColumnRenamed("_k", "_k2").withColumnRenamed("source", "_s2"), (F.col("source") == F.col("_s2")) & F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("line_no") == F.col("_first")), "left_semi").drop("_k")


def blocks(df: DataFrame, starts: Column, ends: Column, ids: bool = True) -> DataFrame:
    """Adds ``in_block``, ``entering``, ``exiting`` and (with ``ids``) ``block_id``: a two-state automaton entered at starts and left at ends.

    Start and end lines belong to the block; a start inside and an end outside are ignored; a line that is both toggles.
    """
    s, e = F.coalesce(starts, F.lit(False)), F.coalesce(ends, F.lit(False))
    df = chunked(df).withColumns({"_set": F.when(s & ~e, 1).when(e & ~s, 0), "_tog": (s & e).cast("long"), "_s": s, "_e": e})
    w = _window()
    df = df.withColumn("_grp", F.count("_set").over(w))
    g = Window.partitionBy(*KEYS, "_grp").orderBy("line_no")
    df = df.withColumn("_base", F.max("_set").over(Window.partitionBy(*KEYS, "_grp"))).withColumn("_par", F.sum("_tog").over(g.rowsBetween(Window.unboundedPreceding, 0)))
    # Of each chunk: the state it ends in if a line has set one, else how often it toggles.
    ends_ = df.groupBy(*KEYS).agg(F.max_by(F.struct("_base", "_par"), "line_no").alias("z"))
    c = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends_ = ends_.withColumn("_cg", F.count("z._base").over(c))
    cg = Window.partitionBy("source", "_cg").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    state = (F.coalesce(F.max("z._base").over(Window.partitionBy("source", "_cg")), F.lit(0)) + F.sum("z._par").over(cg)) % 2
    carry = ends_.withColumn("_st", state).select(*KEYS, F.coalesce(F.lag("_st").over(Window.partitionBy("source").orderBy("chunk")), F.lit(0)).alias("_carry"))
    df = df.join(carry, list(KEYS))
    df = df.withColumn("_after", (F.coalesce("_base", "_carry") + F.col("_par")) % 2)
    df = df.withColumn("_was", F.coalesce(F.lag("_after").over(_window(False)), F.col("_carry")))
    df = df.withColumns({"in_block": (F.col("_was") == 1) | F.col("_s"), "entering": (F.col("_was") == 0) & F.col("_s"), "exiting": (F.col("_was") == 1) & F.col("_e")})
    df = df.drop("_set", "_tog", "_grp", "_base", "_par", "_after", "_was", "_carry", "_s", "_e", "chunk")
    return prefix_sum(df, F.col("entering").cast("long"), "block_id") if ids else df


def context(df: DataFrame, keep: Column, before: int, after: int) -> DataFrame:
    """The kept lines and up to ``before`` lines ahead of and ``after`` lines behind each; adds ``kept``.

    Lines near a chunk's edge are looked at in the neighbouring chunk too, so no window spans a source.
    """
    df = df.withColumn("kept", F.coalesce(keep, F.lit(False)))
    reach = before + after
    edge = F.array_distinct(F.array(F.floor((F.col("line_no") - reach) / CHUNK), F.floor(F.col("line_no") / CHUNK), F.floor((F.col("line_no") + reach) / CHUNK)))
    spread = df.withColumn("chunk", F.explode(edge))
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    near = F.col("kept")
    if before:
        near = near | F.coalesce(F.max("kept").over(w.rowsBetween(1, before)), F.lit(False))
    if after:
        near = near | F.coalesce(F.max("kept").over(w.rowsBetween(-after, -1)), F.lit(False))
    return spread.withColumn("_near", near).filter(F.col("_near") & (F.col("chunk") == F.floor(F.col("line_no") / CHUNK))).drop("_near", "chunk")
