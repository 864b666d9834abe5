"""Multi-version reads and retention over a mutation log (key, seq, kind, value).

kind 0 is a delete, 1 a value; a null or empty value isn't a delete. Filters on the key may run
before the newest version is picked, those on seq must, those on kind and value must not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, VALUE = 0, 1


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    """The log as it was when seq was the last number; None: all of it."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def in_range(log: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in [start, end); None is unbounded, an empty end admits nothing."""
    if start is not None:
        log = log.where(F.col("key") >= F.lit(start))
    return log if end is None else log.where(F.col("key") < F.lit(end))


def newest(log: DataFrame) -> DataFrame:
    """The newest entry of each key, deletes included.

    A partial max_by, so one row a key and task is shuffled, however often a key was written.
    """
    rest = [c for c in log.columns if c != "key"]
    best = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("seq", "kind")).alias("m"))
    return best.select("key", *(F.col(f"m.{c}").alias(c) for c in rest)).select(*log.columns)


def newest_wide(log: DataFrame) -> DataFrame:
    """The same by a window with a group limit: for wide payloads and few versions a key."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scan(log: DataFrame, start=None, end=None, seq: int | None = None) -> DataFrame:
    """Live keys of [start, end) as of seq: (key, value, seq)."""
    return newest(as_of(in_range(log, start, end), seq)).where(F.col("kind") != DELETE).select("key", "value", "seq")


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """The live value of one key: a row, or none."""
    return newest(as_of(log.where(F.col("key") == F.lit(key)), seq)).where(F.col("kind") != DELETE).select("key", "value", "seq")


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """Every row of keys (key) with found 0/1 and value; the log is cut to these keys before it is resolved."""
    wanted = keys.select("key")
    live = newest(as_of(log.join(wanted.distinct(), "key", "left_semi"), seq)).where(F.col("kind") != DELETE)
    return wanted.join(live.select("key", "value", F.lit(1).alias("found")), "key", "left").select("key", F.coalesce("found", F.lit(0)).alias("found"), "value")


def tombstones(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys whose newest entry is a delete."""
    return newest(as_of(log, seq)).where(F.col("kind") == DELETE).select("key", "seq")


def history(log: DataFrame, key) -> DataFrame:
    return log.where(F.col("key") == F.lit(key)).select("key", "seq", "kind", "value").orderBy(F.desc("seq"))


def diff(log: DataFrame, old: int, new: int | None = None) -> DataFrame:
    """key, change (added, removed, changed), old_value, new_value between two sequence numbers.

    One aggregate over the log, not two scans and a join. A key rewritten with an equal value doesn't count.
    """
    log = as_of(log, new)
    entry = F.struct("kind", "value")
    before = F.max_by(F.when(F.col("seq") <= old, entry), F.when(F.col("seq") <= old, F.col("seq")))
    both = log.groupBy("key").agg(before.alias("a"), F.max_by(entry, "seq").alias("b"))
    was, now = F.coalesce(F.col("a.kind") != DELETE, F.lit(False)), F.col("b.kind") != DELETE
    change = F.when(now & ~was, F.lit("added")).when(was & ~now, F.lit("removed")).when(was & now & ~F.col("a.value").eqNullSafe(F.col("b.value")), F.lit("changed"))
    return both.select("key", change.alias("change"), F.when(was, F.col("a.value")).alias("old_value"), F.when(now, F.col("b.value")).alias("new_value")).where("change is not null")


def retain(log: DataFrame, horizon: int, bottom: bool = False) -> DataFrame:
    """What compaction keeps: each version above the horizon and the newest at or under it.

    At the bottom level a delete that is its key's newest entry and not above the horizon goes too.
    No read at or above the horizon changes.
    """
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))
    newer = F.lag("seq").over(w)
    out = log.withColumn("_newer", newer).where(F.col("_newer").isNull() | (F.col("_newer") > horizon))
    if bottom:
        out = out.where(~(F.col("_newer").isNull() & (F.col("kind") == DELETE) & (F.col("seq") <= horizon)))
    return out.drop("_newer")


def dropped(log: DataFrame, horizon: int, bottom: bool = False) -> DataFrame:
    """What compaction drops: the complement of retain."""
    kept = retain(log, horizon, bottom).select("key", "seq")
    return log.join(kept, ["key", "seq"], "left_anti")


def complete_batches(log: DataFrame, size: Column | int) -> DataFrame:
    """Rows of the batches (batch_id) that have all their rows; a torn batch is invisible as a whole."""
    whole = log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size)
    return log.join(whole.select("batch_id"), "batch_id", "left_semi")


def replay(log: DataFrame, last_seq: int) -> DataFrame:
    """Entries that recovery still has to apply."""
    return log.where(F.col("seq") > last_seq)


def amplification(log: DataFrame) -> DataFrame:
    """Logical bytes written and live, and their ratio."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    total = log.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes_in"))
    live = newest(log).where(F.col("kind") != DELETE).agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("live_bytes"))
    return total.join(live).select("bytes_in", "live_bytes", F.when(F.col("bytes_in") > 0, F.round(F.col("live_bytes") / F.col("bytes_in"), 6)).otherwise(0.0).alias("space_amp"))


def merge(logs: list[DataFrame]) -> DataFrame:
    """Several logs as one; sequence numbers alone order what they hold."""
    return reduce(DataFrame.unionByName, logs)
