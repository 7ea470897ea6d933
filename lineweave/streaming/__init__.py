"""Pipelines on unbounded input: each line by itself, with a running summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import hits, replaced, transformed
from ..spec import Pipeline, SpecError


def line_by_line(p: Pipeline, lines: DataFrame) -> DataFrame:
    """``lines`` (value, and any others) with ``out``: the line after the steps, null where it is dropped; no state is kept, so
    steps that need any raise."""
    df = lines.withColumn("_orig", F.col("value"))
    for i, s in p.active:
        pat = s.compiled(s.pattern, p.settings)
        v = F.col("value")
        if s.type == "substitute" and not ("${seq}" in (s.replacement or "") or "${count}" in (s.replacement or "")):
            df = df.withColumn("value", replaced(pat, v, s.replacement or "", s.is_global))
        elif s.type == "transform":
            df = df.withColumn("value", transformed(s, pat, v, p.settings))
        elif s.type == "filter" and s.action in ("keep_line", "drop_line", "keep_match", "drop_match"):
            hit = hits(pat, v)
            if s.not_pattern:
                hit = hit & ~hits(s.compiled(s.not_pattern, p.settings), v)
            keep = hit if s.action.startswith("keep") else ~hit
            df = df.withColumn("value", F.when(~keep if p.settings.invert_match else keep, v))
        elif s.type == "validate":
            df = df.withColumn("value", v if s.on_mismatch == "warn" else F.when(hits(pat, v), v))
        else:
            raise SpecError(f"step {i}: {s.type} needs state or isn't line by line; a stream has none")
    return df.withColumnRenamed("value", "out").withColumnRenamed("_orig", "value")


def summary(p: Pipeline, processed: DataFrame) -> DataFrame:
    """(lines, matched, and for each step how many matched lines its pattern occurs in) of processed lines."""
    changed = ~F.col("value").eqNullSafe(F.col("out"))
    return processed.agg(F.count("*").alias("lines"), F.count_if(changed).alias("matched"), *[F.count_if(changed & hits(s.compiled(s.pattern, p.settings), F.col("value"))).alias(s.description or f"step_{i}") for i, s in p.active])


def rates(p: Pipeline, processed: DataFrame) -> DataFrame:
    """(lines, matched, match_rate) of processed lines, the rate in percent."""
    changed = ~F.col("value").eqNullSafe(F.col("out"))
    g = processed.agg(F.count("*").alias("lines"), F.count_if(changed).alias("matched"))
    return g.withColumn("match_rate", F.when(F.col("lines") > 0, 100.0 * F.col("matched") / F.col("lines")).otherwise(0.0))


def throughput(query) -> dict:  # noqa: ANN001
    """Lines so far and lines per second of a running query, from its progress reports."""
    done = query.recentProgress
    seconds = sum(x["durationMs"].get("triggerExecution", 0) for x in done) / 1000
    lines = sum(x["numInputRows"] for x in done)
    return {"batches": len(done), "lines": lines, "lines_per_second": lines / seconds if seconds else 0.0}


def finish(query, seconds: float = 60.0) -> bool:  # noqa: ANN001
    """Stops a query after the batch it is in; whether that ended in time. What comes later is read by the next start from the checkpoint."""
    import time

    end = time.time() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.time() < end:
        time.sleep(0.05)
    done = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return done


def start(p: Pipeline, source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False):  # noqa: ANN201
    """Runs a pipeline over a streaming source with a column ``value``; ``sink(batch, id)`` gets (value, out) of each batch.

    The checkpoint folder makes a batch that failed come again under the same id, so a sink that keeps ids loses and repeats nothing.
    """
    w = line_by_line(p, source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(df, n))
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def watch(spark: SparkSession, folder: str, schema: str = "value string") -> DataFrame:
    """Lines of files as they come into a folder."""
    return spark.readStream.schema(schema).text(folder)


def dedup_within(lines: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first line of each key, forgetting keys after ``late``; the only bounded form on an endless stream."""
    return lines.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n) by event time; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
