from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from lineweave.operators import incremental as inc

FILE = "file_id long, path string, size long, mtime long, content_hash string, inode long, run_id long"
CHECK = "run_id long, path string, byte_offset long, size long, mtime long, content_hash string, inode long, last_processed long"
RUN = "run_id long, pipeline_id string, status string, finished_at timestamp, read_until long"
MAP = "entry_id long, pipeline_id string, step_index int, original string, transformed string, created_at long, arrived_at timestamp"


def test_changed_files(spark):
    runs = spark.createDataFrame([(1, "p", "succeeded", None, 0), (2, "p", "failed", None, 0)], RUN)
    seen = [(1, p, 10, 10, 5, "h", 7, 1) for p in "abcdefgh"] + [(2, "a", 99, 99, 5, "h", 7, 9), (1, "a", 10, 10, 5, "h", 7, 1), (1, None, 1, 1, 1, None, None, 1)]
    files = spark.createDataFrame(
        [(1, "a", 10, 5, "h", 7, 0), (2, "b", 20, 5, "h", 7, 0), (3, "c", 10, 5, "h", 8, 0), (4, "d", 5, 5, "h", 7, 0), (5, "e", 20, 5, "x", 7, 0), (6, "f", 10, 6, None, 7, 0), (7, "g", 10, 6, "h", None, 0), (8, "new", 1, None, None, None, 0), (9, "h", 10, None, None, None, 0)], FILE
    )
    assert rows(inc.changed_files(files, spark.createDataFrame(seen, CHECK), runs), "record_id") == [(2, 10), (3, 0), (4, 0), (5, 0), (6, 0), (8, 0)]


def test_changed_mappings(spark):
    at = lambda s: datetime.fromtimestamp(s)
    runs = spark.createDataFrame([(1, "p", "succeeded", at(50), 100), (2, "p", "failed", at(90), 900), (3, "q", "running", None, 900)], RUN)
    m = [
        (1, "p", 0, "same", "x", 1, at(10)), (2, "p", 0, "same", "x", 2, at(200)), (3, "p", 0, "new", "x", 1, at(200)), (4, "p", 0, "changed", "x", 1, at(10)), (5, "p", 0, "changed", "y", 2, at(200)),
        (6, "p", 0, "old", "x", 1, at(10)), (7, "p", 0, "late but older", "x", 1, at(200)), (8, "p", 0, "late but older", "y", 9, at(10)), (9, "q", 0, "never run", "x", 1, at(10)),
    ]
    assert [r[0] for r in rows(inc.changed_mappings(spark.createDataFrame(m, MAP), runs), "record_id")] == [3, 5, 9]


def test_empty(spark):
    e = lambda ddl: spark.createDataFrame([], ddl)
    assert inc.work_items(e(FILE), e(CHECK), e(RUN), e(MAP)).count() == 0


def test_ledger(spark, tmp_path):
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    items = spark.createDataFrame([("file", 1, 0), ("file", 2, 5), ("file", 2, 5)], "kind string, record_id long, from_offset long")
    ledger.enqueue(items)
    ledger.enqueue(items)  # found again: nothing new
    assert ledger.states().count() == 2
    old, mine = ledger.lease("a", 10, now=0)
    assert mine.count() == 2 and mine.select("out_path").distinct().count() == 2
    assert ledger.lease("b", 10, now=5)[1].count() == 0  # leased, not pending
    new, again = ledger.lease("b", 10, now=20)  # the first lease has ended
    assert new > old and again.count() == 2
    assert ledger.complete(mine, old, now=21) == 0  # a stale writer
    one = again.filter("record_id = 1")
    assert ledger.complete(one, new, now=21) == 1
    assert ledger.complete(one, new, now=22) == 0  # done already
    assert sorted((r.record_id, r.state) for r in ledger.states(now=100).collect()) == [(1, inc.DONE), (2, inc.PENDING)]
    assert {r.out_path for r in mine.collect()} == {r.out_path for r in again.collect()}  # retries write where the first try wrote


def test_key_is_stable(spark):
    df = spark.range(1).select(F.lit("file").alias("kind"), F.col("id").alias("record_id"))
    assert df.select(inc.item_key("kind", "record_id")).first() == df.select(inc.item_key("kind", "record_id")).first()


def test_a_file_replaced_twice_is_read_twice(spark, tmp_path):
    runs = spark.createDataFrame([(1, "p", "succeeded", None, 0)], RUN)
    seen = spark.createDataFrame([(1, "a", 10, 10, 5, "h", 7, 1)], CHECK)
    none = spark.createDataFrame([], MAP)
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    for inode in (8, 9, 9):
        ledger.enqueue(inc.work_items(spark.createDataFrame([(1, "a", 10, 5, "h", inode, 0)], FILE), seen, runs, none))
        token, mine = ledger.lease("w", 10, now=inode)
        ledger.complete(mine, token, now=inode)
    assert [r.state for r in ledger.states(now=50).collect()] == [inc.DONE] * 2


def test_ledger_survives_what_happens_in_between(spark, tmp_path):
    at = f"{tmp_path}/ledger"
    ledger = inc.Ledger(spark, f"file://{at}")
    ledger.enqueue(spark.createDataFrame([("file", k, 0, "v") for k in (1, 2)], "kind string, record_id long, from_offset long, version string"))
    old, mine = ledger.lease("a", 10, now=0)
    # A completion that was staged and never promoted counts for nothing.
    promote, ledger._promote = ledger._promote, lambda part: None
    assert ledger.complete(mine, old, now=1) == 0
    ledger._promote = promote
    assert {r.state for r in ledger.states(now=2).collect()} == {inc.LEASED}
    # A lease that is given between a completion's check and its promotion makes the completion stale only if its number is smaller.
    number = ledger._next_number()
    new, again = ledger.lease("b", 10, now=20)
    assert new == number + 1 and again.count() == 2
    stale = mine.filter("record_id = 1").select("key", F.lit(old).cast("long").alias("token"), F.lit(new + 1).cast("long").alias("number"), F.lit(21.0).alias("at"))
    early = mine.filter("record_id = 2").select("key", F.lit(old).cast("long").alias("token"), F.lit(number).cast("long").alias("number"), F.lit(21.0).alias("at"))
    ledger._append("done", stale.unionByName(early))
    assert sorted((r.record_id, r.state) for r in ledger.states(now=21).collect()) == [(1, inc.LEASED), (2, inc.DONE)]
    assert [ledger._next_number() for _ in range(3)] == [new + 1, new + 2, new + 3]
