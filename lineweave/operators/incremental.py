"""Processing only new or changed records: a work-item ledger.

Work items are what stands now, folded over what successful runs completed (``fold``); those that no completion covers are
pending. They pass through a ledger with the states pending, leased and done:

* an item's key is a digest of what it asks for, so finding it again adds nothing (no repeats);
* a lease has an end; an item whose lease has ended without being done is pending again (no losses);
* every lease carries a fencing token greater than all before it; a completion counts only if its token is the item's
  latest, so a writer that was thought dead can't overwrite its successor;
* an item's output path follows from its key alone, so a retry replaces what an earlier attempt left.

The ledger is a set of append-only facts; the state is a fold over them, made of aggregations that combine before they
shuffle. ``work_items`` is that fold over the given tables, and ``Ledger.enqueue`` takes its rows: there runs are the leases
and checkpoints the completions, and rows of runs that did not succeed are completions under a token that was never honoured.

Defined results: repeated rows count once; nulls in inode, hash or mtime mean unknown; equal ``last_processed`` goes to the
greater byte offset; rows with a null path, key or pipeline are dropped from checkpoints and kept as they are elsewhere.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import micros
from ..plans import cut

PENDING, LEASED, DONE = "pending", "leased", "done"


def fold(items: DataFrame, done: DataFrame, resume: Column, order: Column) -> DataFrame:
    """The state of each item after its completions: ``items`` (key, ...) with ``from_offset`` and ``state``.

    done: (key, fact, ...), completions under honoured tokens; of each item the one that is last by ``order`` holds, as ``last``.
    resume: from where on the item is still to be worked at, null where ``last`` covers it, in terms of the item's columns and ``last``.
    """
    last = done.groupBy("key").agg(F.max_by("fact", order).alias("last"))
    out = items.join(last, "key", "left").withColumn("from_offset", resume)
    return out.withColumn("state", F.when(F.col("from_offset").isNull(), DONE).otherwise(PENDING))


def honoured(completions: DataFrame, runs: DataFrame) -> DataFrame:
    """The completions whose run (their lease) succeeded; the tokens of other runs were never honoured."""
    return completions.join(runs.filter("status = 'succeeded'").select("run_id").distinct(), "run_id", "left_semi")


def file_items(source_files: DataFrame, checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, record_id, from_offset, version, state): every file as it stands now, folded over what runs completed."""
    fact = F.struct("byte_offset", "mtime", "content_hash", "inode").alias("fact")
    done = honoured(checkpoints, runs).filter("path is not null").select(F.col("path").alias("key"), fact, "last_processed", "byte_offset", "run_id")
    items = source_files.select(F.col("path").alias("key"), F.col("file_id").alias("record_id"), "size", "mtime", "content_hash", "inode")
    zero, was = F.lit(0).cast("long"), F.col("last")
    differ = lambda c: F.coalesce(F.col(c) != was[c], F.lit(False))
    resume = (
        F.when(was.isNull(), zero)
        .when(differ("inode"), zero)
        .when(F.col("size") < was["byte_offset"], zero)
        .when(differ("content_hash"), zero)
        .when(F.col("size") > was["byte_offset"], was["byte_offset"])
        .when((F.col("content_hash").isNull() | was["content_hash"].isNull()) & F.coalesce(F.col("mtime") > was["mtime"], F.lit(False)), zero)
    )
    states = fold(items, done, resume, F.struct("last_processed", "byte_offset", "run_id"))
    version = F.to_json(F.struct("inode", "content_hash", "size", "mtime"))
    return states.select(F.lit("file").alias("kind"), "record_id", "from_offset", version.alias("version"), "state")


def marks(runs: DataFrame) -> DataFrame:
    """(pipeline_id, mark): what had arrived by then was read by the pipeline's last successful run."""
    return runs.filter("status = 'succeeded'").groupBy("pipeline_id").agg(F.max_by("read_until", F.struct("finished_at", "run_id")).alias("mark"))


def mapping_items(mapping_entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, record_id, from_offset, version, state): the current version of each mapping; the newest version that had arrived by
    the pipeline's mark is its last completion, and covers the current one if that had arrived too or says the same."""
    m = mapping_entries.select("entry_id", "pipeline_id", "step_index", "original", "transformed", "created_at", "arrived_at").join(marks(runs), "pipeline_id", "left")
    order = F.struct("created_at", "entry_id")
    after = F.col("mark").isNull() | (micros(m, "arrived_at") > F.col("mark") * 1_000_000)
    # Items and completions are rows of one table here, so one aggregation folds both.
    states = m.groupBy("pipeline_id", "step_index", "original").agg(
        F.max_by(F.struct("entry_id", "transformed", after.alias("after")), order).alias("now"), F.max_by(F.struct("transformed"), F.when(~after, order)).alias("last")
    )
    covered = ~F.col("now.after") | (F.col("last").isNotNull() & F.col("now.transformed").eqNullSafe(F.col("last.transformed")))
    return states.select(
        F.lit("mapping").alias("kind"), F.col("now.entry_id").alias("record_id"), F.when(~covered, F.lit(0)).cast("long").alias("from_offset"), F.col("now.entry_id").cast("string").alias("version"), F.when(covered, DONE).otherwise(PENDING).alias("state")
    )


def work_items(source_files: DataFrame, checkpoints: DataFrame, runs: DataFrame, mapping_entries: DataFrame) -> DataFrame:
    """(kind, record_id, from_offset, version) of everything the next run must take up: the pending items."""
    every = file_items(source_files, checkpoints, runs).unionByName(mapping_items(mapping_entries, runs))
    return every.filter(F.col("state") == PENDING).drop("state")


def changed_files(source_files: DataFrame, checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """(record_id, from_offset) of the files to read, and from which byte on."""
    return file_items(source_files, checkpoints, runs).filter(F.col("state") == PENDING).select("record_id", "from_offset")


def changed_mappings(mapping_entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(record_id) of the mappings to take up."""
    return mapping_items(mapping_entries, runs).filter(F.col("state") == PENDING).select("record_id")


def item_key(*columns: str) -> Column:
    """A digest that is the same whenever the same work is asked for."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


class Ledger:
    """A ledger of work items in ``folder``: the facts ``items``, ``leases`` and ``done``, each appended to and never changed.

    Leases and completions take their numbers from one counter. A completion counts if its token was the item's latest lease
    of those with a smaller number than the completion has, whatever was written down first: the fold decides, so nothing
    that happens between a check and a write can let a stale writer in.
    """

    ITEMS = "key string, kind string, record_id bigint, from_offset bigint, version string"
    LEASES = "key string, token bigint, worker string, expires_at double"
    DONE_ROWS = "key string, token bigint, number bigint, at double"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, ddl: str) -> DataFrame:
        at, fs = self._path(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def enqueue(self, items: DataFrame) -> None:
        """Adds (kind, record_id, from_offset, version) as pending; items that are there already, in any state, stay as they are.

        The version tells what stands at a place from what stood there before, so a file that is replaced twice is two items
        though both are read from byte 0.
        """
        version = F.coalesce(F.col("version").cast("string"), F.lit("")) if "version" in items.columns else F.lit("")
        items = items.select("kind", "record_id", F.col("from_offset").cast("long").alias("from_offset"), version.alias("version")).dropDuplicates()
        items = items.withColumn("key", item_key("kind", "record_id", "from_offset", "version"))
        self._append("items", items.join(self._read("items", self.ITEMS).select("key"), "key", "left_anti").select("key", "kind", "record_id", "from_offset", "version"))

    def states(self, now: float | None = None) -> DataFrame:
        """(key, kind, record_id, from_offset, version, state, token)."""
        now = time.time() if now is None else now
        leases = self._read("leases", self.LEASES)
        latest = leases.groupBy("key").agg(F.max_by(F.struct("token", "expires_at"), "token").alias("l"))
        done = self._read("done", self.DONE_ROWS)
        # A completion is stale if a lease with a number between its token and its own was given on the item.
        later = done.join(leases.select("key", F.col("token").alias("_t")), "key").filter((F.col("_t") > F.col("token")) & (F.col("_t") < F.col("number"))).select("key", "number").distinct()
        good = done.join(later, ["key", "number"], "left_anti").groupBy("key").agg(F.max("number").alias("number"))
        s = self._read("items", self.ITEMS).dropDuplicates(["key"]).join(latest, "key", "left").join(good, "key", "left")
        state = F.when(F.col("number").isNotNull(), DONE).when(F.col("l.expires_at") > now, LEASED).otherwise(PENDING)
        return s.select("key", "kind", "record_id", "from_offset", "version", state.alias("state"), F.col("l.token").alias("token"))

    def lease(self, worker: str, seconds: float, most: int | None = None, now: float | None = None) -> tuple[int, DataFrame]:
        """Leases pending items (all, or the ``most`` smallest keys) to ``worker``: the fencing token, and the items.

        Of two that lease the same item at once the greater token holds it.
        """
        now = time.time() if now is None else now
        token = self._next_number()
        items = self.states(now).filter(F.col("state") == PENDING)
        if most is not None:
            items = items.orderBy("key").limit(most)
        self._append("leases", items.select("key", F.lit(token).cast("long").alias("token"), F.lit(worker).alias("worker"), F.lit(now + seconds).alias("expires_at")))
        mine = self._read("leases", self.LEASES).groupBy("key").agg(F.max("token").alias("token")).filter(F.col("token") == token).select("key")
        items = self._read("items", self.ITEMS).join(mine, "key", "left_semi").withColumn("out_path", F.concat(F.lit(f"{self.folder}/out/"), F.col("kind"), F.lit("/"), F.col("key")))
        # Written down: a plan that reads the facts as they are now must not meet, in one query, one that reads them later.
        return token, cut(items)

    def _next_number(self) -> int:
        """A number greater than all before it, claimed by creating a file that must not exist yet; found without listing the folder."""
        root, fs = self._path("tokens")
        fs.mkdirs(root)
        there = lambda n: fs.exists(self._path(f"tokens/{n}")[0])
        low, step = 0, 1
        while there(low + step):
            low, step = low + step, 2 * step
        high = low + step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if there(mid) else (low, mid)
        n = low + 1
        while not fs.createNewFile(self._path(f"tokens/{n}")[0]):
            n += 1
        return n

    def complete(self, keys: DataFrame, token: int, now: float | None = None) -> int:
        """Marks (key) as done under ``token``; returns how many count. Items with a later lease, or none, are rejected."""
        now = time.time() if now is None else now
        number = self._next_number()
        held = self._read("leases", self.LEASES).filter(F.col("token") == token).select("key").distinct()
        open_ = self.states(now).filter(F.col("state") != DONE).select("key")
        rows = keys.select("key").distinct().join(held, "key", "left_semi").join(open_, "key", "left_semi").select("key", F.lit(token).cast("long").alias("token"), F.lit(number).cast("long").alias("number"), F.lit(now).alias("at"))
        part = f"staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        self._promote(part)
        mine = self._read("done", self.DONE_ROWS).filter(F.col("number") == number).select("key")
        return self.states(now).filter(F.col("state") == DONE).join(mine, "key", "left_semi").count()

    def _promote(self, part: str) -> None:
        """Moves staged rows into ``done``, file by file; each row counts by itself, and staged ones that are left over don't."""
        root, fs = self._path(part)
        fs.mkdirs(self._path("done")[0])
        for f in fs.listStatus(root):
            if f.getPath().getName().endswith(".parquet"):
                fs.rename(f.getPath(), self._path(f"done/{uuid.uuid4().hex}.parquet")[0])
        fs.delete(root, True)
