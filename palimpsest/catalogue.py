"""The engine's queries over the standard tables, and the SQL that states each of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import compaction, mvcc
from .sources.logs import events_log, orders_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_EVENTS = """log as (
  select 'u' || lpad(cast(user_id as varchar), cast(greatest(8, length(cast(user_id as varchar))) as integer), '0') as key, event_id + 1 as seq, case when event_type = 'error' then 0 else 1 end as kind,
         case when event_type = 'error' then null else event_type || ':' || props end as value from events)"""
_ORDERS = "log as (select 'o' || lpad(cast(o_orderkey as varchar), cast(greatest(12, length(cast(o_orderkey as varchar))) as integer), '0') as key, o_orderkey + 1 as seq, 1 as kind, o_orderstatus as value from orders)"


def _newest(where: str = "true", source: str = "log", name: str = "r") -> str:
    return f"{name} as (select *, row_number() over (partition by key order by seq desc) as rn from {source} where {where})"


def _live(where: str = "true") -> str:
    return f"with {_EVENTS}, {_newest(where)} select key, value, seq from r where rn = 1 and kind = 1"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_live())
def get_latest_all(spark, d):
    return mvcc.scan(events_log(spark, d))


@query(_live())
def get_latest_wide(spark, d):
    return mvcc.newest_wide(events_log(spark, d)).where("kind = 1").select("key", "value", "seq")


@query(_live("seq <= 5000"))
def snapshot_scan(spark, d):
    return mvcc.scan(events_log(spark, d), seq=5000)


@query(_live("key >= 'u00000020' and key < 'u00000060'"))
def range_scan(spark, d):
    return mvcc.scan(events_log(spark, d), "u00000020", "u00000060")


@query(_live("key < 'u00000010'"))
def scan_unbounded_low(spark, d):
    return mvcc.scan(events_log(spark, d), None, "u00000010")


@query(_live("key >= 'u00000100'"))
def scan_unbounded_high(spark, d):
    return mvcc.scan(events_log(spark, d), "u00000100")


@query(_live("key >= 'u00000060' and key < 'u00000020'"))
def scan_inverted(spark, d):
    return mvcc.scan(events_log(spark, d), "u00000060", "u00000020")


@query(_live("key < ''"))
def scan_empty_end(spark, d):
    return mvcc.scan(events_log(spark, d), None, "")


@query(_live("key = 'u00000002'"))
def point_get(spark, d):
    return mvcc.get(events_log(spark, d), "u00000002")


@query(_live("seq <= 5000 and key = 'u00000002'"))
def snapshot_get(spark, d):
    return mvcc.get(events_log(spark, d), "u00000002", 5000)


@query(_live("key = 'u00000005'"))
def get_deleted(spark, d):
    return mvcc.get(events_log(spark, d), "u00000005")


@query(f"with {_EVENTS}, {_newest()} select key, seq from r where rn = 1 and kind = 0")
def tombstones(spark, d):
    return mvcc.tombstones(events_log(spark, d))


@query(f"""with {_EVENTS}, {_newest()}, p(key) as (values ('u00000002'), ('u00000005'), ('u99999999'))
select p.key, case when r.key is null then 0 else 1 end as found, r.value from p left join (select * from r where rn = 1 and kind = 1) r using (key)""")
def multi_get(spark, d):
    keys = spark.createDataFrame([("u00000002",), ("u00000005",), ("u99999999",)], "key string")
    return mvcc.multi_get(events_log(spark, d), keys)


@query(f"""with {_EVENTS}, {_newest("seq <= 5000", name="r1")}, {_newest("seq <= 9000", name="r2")},
a as (select key, value from r1 where rn = 1 and kind = 1), b as (select key, value from r2 where rn = 1 and kind = 1)
select key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change, a.value as old_value, b.value as new_value
from a full join b using (key) where a.key is null or b.key is null or a.value is distinct from b.value""")
def snap_diff(spark, d):
    return mvcc.diff(events_log(spark, d), 5000, 9000)


@query(f"with {_EVENTS} select key, seq, kind, value from log where key = 'u00000005'")
def history(spark, d):
    return mvcc.history(events_log(spark, d), "u00000005")


@query(f"with {_EVENTS} select key, seq, kind, row_number() over (order by key, seq desc, kind desc) as pos from log")
def ikey_order(spark, d):
    """Positions in internal order, without one task that sees all rows: ranks inside ranges of the key, plus offsets.

    The number of ranges is fixed by the shuffle setting, so the table of their counts is small.
    """
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log = events_log(spark, d).select("key", "seq", "kind")
    cuts = [r for r in log.agg(F.percentile_approx(F.conv(F.substring("key", 2, 8), 10, 10).cast("long"), [i / n for i in range(1, n)] or [0.5], 1000).alias("q")).first()["q"] or []]
    part = F.lit(0)
    for c in cuts:
        part = part + (F.substring("key", 2, 8).cast("long") > c).cast("int")
    log = log.withColumn("part", part)
    counts = log.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("key", F.desc("seq"), F.desc("kind"))
    return log.join(F.broadcast(offsets), "part").select("key", "seq", "kind", (F.col("before") + F.row_number().over(w)).alias("pos"))


def _retained(m: int, bottom: bool) -> str:
    extra = f"and not (newer is null and kind = 0 and seq <= {m})" if bottom else ""
    return f"kept as (select key, seq, kind, value from (select *, lag(seq) over (partition by key order by seq desc) as newer from log) where (newer is null or newer > {m}) {extra})"


def _retain_query(name: str, m: int, bottom: bool) -> None:
    def f(spark, d):
        return mvcc.retain(events_log(spark, d), m, bottom)

    f.__name__ = name
    query(f"with {_EVENTS}, {_retained(m, bottom)} select * from kept")(f)


for _name, _m, _bottom in (("retain_mid", 7000, False), ("retain_bottom", 7000, True), ("retain_9950_mid", 9950, False), ("retain_9950_bottom", 9950, True), ("retain_10000_mid", 10000, False), ("retain_10000_bottom", 10000, True)):
    _retain_query(_name, _m, _bottom)


@query(f"with {_EVENTS}, {_retained(7000, False)} select key, seq, kind, value from log where (key, seq) not in (select (key, seq) from kept)")
def versions_dropped(spark, d):
    return mvcc.dropped(events_log(spark, d), 7000)


_LAW = " union all ".join(
    f"select {s} as as_of, (select count(*) from (select key, value from (select *, row_number() over (partition by key order by seq desc) rn from log where seq <= {s}) where rn = 1 and kind = 1 except select key, value from (select *, row_number() over (partition by key order by seq desc) rn from kept where seq <= {s}) where rn = 1 and kind = 1)) as lost,"
    f" (select count(*) from (select key, value from (select *, row_number() over (partition by key order by seq desc) rn from kept where seq <= {s}) where rn = 1 and kind = 1 except select key, value from (select *, row_number() over (partition by key order by seq desc) rn from log where seq <= {s}) where rn = 1 and kind = 1)) as gained"
    for s in (3000, 7000, 9000)
)


@query(f"with {_EVENTS}, {_retained(7000, False)} {_LAW}")
def retention_law(spark, d):
    """Rows that a read loses and gains by retention, for a read under the horizon and two not under it."""
    log = events_log(spark, d)
    kept = mvcc.retain(log, 7000)
    out = None
    for s in (3000, 7000, 9000):
        a = mvcc.scan(log, seq=s).select("key", "value", F.lit(1).alias("a"))
        b = mvcc.scan(kept, seq=s).select(F.col("key"), F.col("value").alias("v2"), F.lit(1).alias("b"))
        j = a.join(b, "key", "full")
        same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("value").eqNullSafe(F.col("v2"))
        row = j.agg(F.coalesce(F.sum((F.col("a").isNotNull() & ~same).cast("long")), F.lit(0)).alias("lost"), F.coalesce(F.sum((F.col("b").isNotNull() & ~same).cast("long")), F.lit(0)).alias("gained")).select(F.lit(s).alias("as_of"), "lost", "gained")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with {_EVENTS}, l2 as (select *, cast(floor((seq - 1) / 7) as bigint) as batch_id from log),
ok as (select batch_id from l2 group by 1 having count(*) = 7), {_newest(source="(select * from l2 where batch_id in (select batch_id from ok))")}
select key, value, seq from r where rn = 1 and kind = 1""")
def batch_atomic(spark, d):
    log = events_log(spark, d).withColumn("batch_id", F.floor((F.col("seq") - 1) / 7).cast("long"))
    return mvcc.scan(mvcc.complete_batches(log, 7))


@query(f"with {_EVENTS} select cast(floor((seq - 1) / 7) as bigint) as batch_id, count(*) as n from log group by 1 having count(*) <> 7")
def batch_incomplete(spark, d):
    return events_log(spark, d).groupBy(F.floor((F.col("seq") - 1) / 7).cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("n")).where("n <> 7")


@query(f"with {_EVENTS} select count(*) as n, max(seq) as last_seq from log where seq > 4000")
def replay_skip(spark, d):
    return mvcc.replay(events_log(spark, d), 4000).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


_META = "meta as (select cast(floor((seq - 1) / 1000) as bigint) as file, min(key) as smallest, max(key) as largest, count(*) as n, min(seq) as min_seq, max(seq) as max_seq from log group by 1)"


@query(f"with {_EVENTS}, {_META} select * from meta")
def file_meta(spark, d):
    return compaction.file_meta(events_log(spark, d), 1000)


@query(f"with {_EVENTS}, {_META} select * from meta where not (largest < 'u00000020' or smallest >= 'u00000060')")
def overlap_files(spark, d):
    return compaction.files_in_range(compaction.file_meta(events_log(spark, d), 1000), "u00000020", "u00000060")


@query(f"with {_ORDERS}, {_META} select * from meta where not (largest < 'o000000002500' or smallest >= 'o000000004200')")
def orders_files_touched(spark, d):
    return compaction.files_in_range(compaction.file_meta(orders_log(spark, d), 1000), "o000000002500", "o000000004200")


@query(f"with {_ORDERS}, {_newest("key >= 'o000000002500' and key < 'o000000004200'")} select key, value, seq from r where rn = 1 and kind = 1")
def orders_kv_scan(spark, d):
    return mvcc.scan(orders_log(spark, d), "o000000002500", "o000000004200")


@query(f"with {_ORDERS}, {_META}, p as (select key from log where (seq - 1) % 100 = 0) select count(*) as touched, count(distinct p.key) as gets from p join meta on p.key between smallest and largest")
def read_amp_orders(spark, d):
    """Files that point reads touch. The files' table has a row a segment, the probes are a stated set."""
    log = orders_log(spark, d)
    meta = compaction.file_meta(log, 1000)
    probes = log.where((F.col("seq") - 1) % 100 == 0).select("key")
    return probes.join(meta, F.col("key").between(F.col("smallest"), F.col("largest"))).agg(F.count(F.lit(1)).alias("touched"), F.countDistinct("key").alias("gets"))


@query(f"""with {_EVENTS}, {_newest()}, i as (select cast(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) as bigint) as bytes_in from log),
l as (select cast(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) as bigint) as live_bytes from r where rn = 1 and kind = 1)
select bytes_in, live_bytes, round(cast(live_bytes as double) / bytes_in, 6) as space_amp from i, l""")
def space_amp(spark, d):
    return mvcc.amplification(events_log(spark, d))


def _files(spark, d, of_level: Callable[[int], int], size: int = 10) -> list[compaction.File]:
    """Metadata of segments of 1,000 versions as the pickers take it: a row a segment, as a manifest holds it."""
    rows = compaction.file_meta(events_log(spark, d), 1000).collect()
    return [compaction.File(r["file"], of_level(r["file"]), r["n"] * size, r["smallest"].encode(), r["largest"].encode(), r["n"], r["min_seq"], r["max_seq"]) for r in rows]


@query(f"with {_EVENTS}, {_META} select case when count(*) >= 4 then 0 else -1 end as level from meta")
def l0_pick(spark, d):
    level = compaction.pick_level(_files(spark, d, lambda f: 0), compaction.Options(l0_trigger=4))
    return spark.createDataFrame([(level,)], "level int")


_LEVELS = "lv as (select *, 1 + cast(file % 3 as int) as level, n * 10 as size from meta)"


def _third(file: int) -> int:
    return 1 + file % 3


@query(f"""with {_EVENTS}, {_META}, {_LEVELS}, s as (select level, sum(size) as bytes from lv group by 1)
select coalesce(min(level), -1) as level from s where bytes >= 2000 * power(4, level - 1)""")
def level_pick(spark, d):
    level = compaction.pick_level(_files(spark, d, _third), compaction.Options(level_base=2000, multiplier=4))
    return spark.createDataFrame([(level,)], "level int")


@query(f"""with {_EVENTS}, {_META}, {_LEVELS}, a as (select * from lv where level = 1 order by smallest, file limit 1)
select file, level from a union all select b.file, b.level from a join (select * from lv where level = 2) b on not (b.largest < a.smallest or b.smallest > a.largest)""")
def compaction_inputs(spark, d):
    """The files that a compaction of level 1 takes: its own of the smallest key, and those of level 2 that it meets."""
    files = _files(spark, d, _third)
    own = compaction.pick_inputs(files, 1)
    met = [x for f in own for x in compaction.overlapping(files, 2, f.smallest, f.largest)]
    return spark.createDataFrame([(f.num, f.level) for f in own + met], "file long, level int")


@query(f"with {_EVENTS}, {_META}, {_LEVELS}, a as (select * from lv where level = 1), b as (select * from lv where level = 2) select a.file as upper_file, b.file as lower_file from a join b on not (b.largest < a.smallest or b.smallest > a.largest)")
def level_overlap(spark, d):
    """Pairs of files of neighbouring levels whose closed key ranges meet."""
    files = _files(spark, d, _third)
    pairs = [(a.num, b.num) for a in files if a.level == 1 for b in compaction.overlapping(files, 2, a.smallest, a.largest)]
    return spark.createDataFrame(pairs, "upper_file long, lower_file long")


@query(f"with {_EVENTS}, {_META}, {_LEVELS} select max(level) as deepest_level, cast(2 + 10 * (greatest(max(level), 1) - 1) as double) as model from lv")
def wa_model(spark, d):
    level = compaction.deepest(_files(spark, d, _third))
    return spark.createDataFrame([(level, compaction.write_amp_model(level))], "deepest_level int, model double")


@query(f"with {_EVENTS} select key, seq, kind, hex(encode(key)) || lpad(hex(seq * 256 + kind), 16, '0') as ikey from log")
def internal_keys(spark, d):
    from .functions.codec import internal_key

    log = events_log(spark, d)
    return log.select("key", "seq", "kind", F.hex(internal_key(F.col("key"), F.col("seq"), F.col("kind"))).alias("ikey"))


@query()
def crc_rows(spark, d):
    """CRC-32C of each live row; DuckDB has no such function."""
    from .functions.codec import crc32c_column

    live = mvcc.scan(events_log(spark, d))
    return live.select("key", crc32c_column(F.concat(F.col("key").cast("binary"), F.col("value").cast("binary"))).alias("crc"))


def _store(spark, d, **options):
    """A store of the events log, written in four batches, and what was read before each of them: (store, root, snapshots)."""
    from .plans.store import Options, Store

    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{conf.rstrip('/')}/store-{uuid.uuid4().hex}" if conf else "file://" + tempfile.mkdtemp(prefix="store-")
    store, snapshots = Store(spark, root, Options(**{"l0_trigger": 4} | options)), []
    log = events_log(spark, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    for i in range(4):
        snapshots.append(store.snapshot())
        part = log.where((F.col("seq") > last * i // 4) & (F.col("seq") <= last * (i + 1) // 4))
        store.write(part.select(F.col("seq").alias("pos"), "key", "kind", "value"))
    return store, root, snapshots


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_HALF = "(select max(seq) // 2 from log)"


@query(f"with {_EVENTS}, {_newest()} select key, value from r where rn = 1 and kind = 1")
def store_scan(spark, d):
    """The events log written to a store in four batches, compacted, and scanned."""
    return _text(_store(spark, d)[0].scan())


@query(f"with {_EVENTS}, {_newest(f'seq <= {_HALF}')} select key, value from r where rn = 1 and kind = 1")
def store_snapshot_scan(spark, d):
    """A snapshot taken after two of the four batches, read when the fourth has started a compaction."""
    return _text(_store(spark, d)[2][2].scan())


@query(f"with {_EVENTS}, {_newest()} select key, value from r where rn = 1 and kind = 1 and key >= 'u00000020' and key < 'u00000060'")
def store_recovered_scan(spark, d):
    """A range of a store that was closed, opened again from its manifest, and had its checksums compared."""
    from .plans.store import Store

    store, root, _ = _store(spark, d)
    store.close()
    again = Store(spark, root)
    again.checksum_all()
    return _text(again.scan(b"u00000020", b"u00000060"))


@query(f"""with {_EVENTS}, {_newest()}, p(key) as (values ('u00000002'), ('u00000005'), ('u99999999'))
select p.key, case when r.key is null then 0 else 1 end as found, r.value from p left join (select * from r where rn = 1 and kind = 1) r using (key)""")
def store_multi_get(spark, d):
    keys = spark.createDataFrame([("u00000002",), ("u00000005",), ("u99999999",)], "key string")
    got = _store(spark, d)[0].multi_get(keys.select(F.col("key").cast("binary").alias("key")))
    return got.select(F.col("key").cast("string").alias("key"), "found", F.col("value").cast("string").alias("value"))


@query(f"with {_EVENTS}, {_newest()} select cast(max(seq) as bigint) as last_seq, (select count(*) from r where rn = 1 and kind = 1) as rows_at_bottom from log")
def store_last_level(spark, d):
    """With two levels, a compaction reaches the last one: one version a live key stays, and no delete."""
    store, _, snapshots = _store(spark, d, levels=2, l0_trigger=5)
    for s in snapshots:
        s.release()
    store.compact_level(0)
    return spark.createDataFrame([(store.last_seq, sum(f.count for f in store.state.files))], "last_seq long, rows_at_bottom long")
