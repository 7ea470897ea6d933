"""Filling containers of fixed capacity with documents, by their size in tokens.

Method: hierarchical residual packing. Each partition packs its pieces best-fit decreasing and emits the containers that are
nearly full; what is left in underfull ones travels on as single items (id and size only, never text) to a tree of merges:
each round brings the leftovers of FAN partitions together and packs them again, until one partition holds what is left.

A document longer than a container is cut into full containers and one rest; the rest is an item like any other. No other
document is cut.

Defined results: null and empty texts have no tokens and get no container; repeated documents are packed each for itself;
ties go to the smaller id, so a run over the same partitions gives the same containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut
from .subwords import FOLDER, encoding

CAPACITY = 2048
#: A container is emitted once no more than this share of it is unused.
SLACK = 0.01
FAN = 8


def with_tokens(documents: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, tokens)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens bigint")


def best_fit(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Containers of (size, item): best-fit decreasing with a sorted list of open containers by room left."""
    bins: list[list[tuple[int, object]]] = []
    room: list[tuple[int, int]] = []
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append((size, item))
        else:
            left, b = capacity, len(bins)
            bins.append([(size, item)])
        if left > size:
            insort(room, (left - size, b))
    return bins


_OUT = "doc_id {kind}, part bigint, tokens bigint, container string, position int, done boolean"


def _pack(level: int, capacity: int, floor: float, last: bool):  # noqa: ANN202
    """Packs the (doc_id, part, tokens) of a partition; container names hold the level and the partition, so they are unique."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        items: list[tuple[int, tuple]] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            items += list(zip(batch.column(2).to_pylist(), zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        if not items:
            return
        rows: list[tuple] = []
        for n, b in enumerate(best_fit(items, capacity)):
            done = last or sum(s for s, _ in b) >= floor
            rows += [(d, p, s, f"{level}-{at}-{n}" if done else None, i if done else None, done) for i, (s, (d, p)) in enumerate(b)]
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.bool_())],
            ["doc_id", "part", "tokens", "container", "position", "done"],
        )

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, fan: int = FAN) -> DataFrame:
    """(doc_id, part, tokens, container, position) from (doc_id, tokens). Parts of a cut document count from 0."""
    kind = sizes.schema["doc_id"].dataType.simpleString()
    whole = F.floor(F.col("tokens") / capacity)
    sizes = sizes.filter("tokens > 0")
    # Full containers of documents that exceed one; each is a container of its own.
    full = sizes.filter(F.col("tokens") > capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"))
    full = full.select("doc_id", "part", F.lit(capacity).cast("long").alias("tokens"), F.concat(F.lit("full-"), F.monotonically_increasing_id().cast("string")).alias("container"), F.lit(0).alias("position"))
    over = F.col("tokens") > capacity
    rest = sizes.select("doc_id", F.when(over, whole).otherwise(0).cast("long").alias("part"), F.when(over, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("tokens")).filter("tokens > 0")
    out, ddl, level = [full], _OUT.format(kind=kind), 0
    parts = rest.rdd.getNumPartitions()
    floor = capacity * (1 - slack)
    while True:
        last = parts <= 1
        packed = cut(rest.mapInArrow(_pack(level, capacity, floor, last), ddl))
        out.append(packed.filter("done").select("doc_id", "part", "tokens", "container", "position"))
        if last:
            break
        level += 1
        parts = -(-parts // fan)
        rest = packed.filter("not done").select("doc_id", "part", "tokens").repartition(parts, F.xxhash64("doc_id", "part"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER) -> DataFrame:
    return pack(cut(with_tokens(documents, folder)), capacity)


__all__ = ["CAPACITY", "best_fit", "pack", "pack_documents", "with_tokens"]
