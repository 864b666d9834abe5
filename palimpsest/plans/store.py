"""A versioned key-value store on Parquet segments.

A batch is written as a sorted segment in a folder that no commit names, then published by one
commit: durable and visible at once, or not at all. A snapshot holds a sequence number and a list
of files; files that an open snapshot or a young version may read are not removed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import MAX_SEQ
from ..operators import mvcc
from ..operators.compaction import File, Options, deepest, overlapping, pick_inputs, pick_level, scan_files, write_amp_model
from .manifest import Corruption, Files, Manifest, State, StoreError

SCHEMA = "key binary, seq long, kind int, value binary"


class Closed(StoreError):
    pass


class ReadOnly(StoreError):
    pass


class BatchTooLarge(StoreError):
    """A Batch over max_batch_bytes; nothing was written. DataFrames have no limit."""


class NotFound(StoreError, KeyError):
    pass


class Batch:
    """Puts and deletes in order; inputs are copied."""

    def __init__(self):
        self.rows: list[tuple[int, bytes, int, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> Batch:
        self.rows.append((len(self.rows), bytes(key), mvcc.VALUE, bytes(value)))
        return self

    def delete(self, key: bytes) -> Batch:
        self.rows.append((len(self.rows), bytes(key), mvcc.DELETE, None))
        return self

    def count(self) -> int:
        return len(self.rows)


class Snapshot:
    """Reads at a sequence number. release() may be called twice; later reads fail."""

    def __init__(self, store: Store, state: State):
        self.store, self.state, self.seq, self.open = store, state, state.last_seq, True

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self._check()
        return self.store._scan(self.state, start, end, self.seq)

    def get(self, key: bytes) -> bytes:
        self._check()
        return self.store._get(self.state, key, self.seq)

    def release(self) -> None:
        self.open = False
        self.store.snapshots.discard(self)

    def _check(self) -> None:
        self.store._live()
        if not self.open:
            raise Closed("snapshot was released")


class Store:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options(), files: Files | None = None):
        """Open or create. Recovery is reading the manifest; segments that no commit ever named, and temporary files, are removed once older than grace_s."""
        self.spark, self.options = spark, options
        self.files = files or Files(spark, root)
        self.files.sync = options.sync
        self.manifest = Manifest(self.files, options.checkpoint_every)
        self.snapshots: set[Snapshot] = set()
        self.closed = False
        self.counters = {"bytes_in": 0, "bytes_written": 0, "gets": 0, "files_touched": 0, "commits": 0}
        if not self.files.names("manifest"):
            if self.files.names("segments"):
                raise Corruption("there are segments, but no manifest")
            if options.read_only:
                raise ReadOnly("no store to open")
            for d in ("manifest", "segments", "tmp"):
                self.files.mkdirs(d)
            self.state = self.manifest.commit(State(), [], [], 0, 1)
        else:
            self.state = self.manifest.load()
        for f in self.state.files:
            if not self.files.exists(f"segments/{f.name}"):
                raise Corruption(f"segment {f.num} is missing")
        if not options.read_only:
            self._remove_unnamed(self.manifest.named, options.grace_s)

    # writes

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(Batch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(Batch().delete(key))

    def write(self, batch: Batch | DataFrame, batch_id: str | tuple[str, int] | None = None) -> int:
        """Commit a batch as a whole and return the last sequence number.

        A DataFrame has pos, key, kind and value; its rows are numbered in the order of pos, ties in
        any order. A batch_id that was committed before is skipped; of a (name, number), so is every
        number up to the highest that was committed, and only that one is kept.
        """
        if isinstance(batch, Batch):
            if not batch.rows:
                return self.state.last_seq
            self._writable()
            if sum(len(k) + len(v or b"") for _, k, _, v in batch.rows) > self.options.max_batch_bytes:
                raise BatchTooLarge(f"a batch holds at most {self.options.max_batch_bytes} bytes")
            batch = self.spark.createDataFrame(batch.rows, "pos long, key binary, kind int, value binary")
        self._writable()
        marks = (batch_id,) if isinstance(batch_id, tuple) else ()
        if batch_id in self.state.batches or any(n <= dict(self.state.marks).get(name, -1) for name, n in marks):
            return self.state.last_seq
        num = self.state.next_file
        staging = f"tmp/{num:08d}-{uuid.uuid4().hex[:12]}"
        staged, n = self._numbered(batch, staging)
        if not n:
            return self.state.last_seq
        if self.state.last_seq + n > MAX_SEQ:
            raise StoreError("sequence numbers are used up")
        file = self._write_segment(staged, num, 0, n)
        last = self.state.last_seq + n
        self.state = self.manifest.commit(self.state, [file], [], last, num + 1, (batch_id,) if isinstance(batch_id, str) else (), marks)
        self.files.remove(staging)
        self.counters["bytes_in"] += file.bytes_in
        self.counters["commits"] += 1
        if self.options.auto_compact:
            self.compact_until_quiet()
        return last

    def _numbered(self, batch: DataFrame, staging: str) -> tuple[DataFrame, int]:
        """Rows with consecutive numbers: range-partitioned by pos, numbered in each partition, offsets from the counts."""
        rows = batch.select(F.col("pos").cast("long").alias("pos"), F.col("key").cast("binary").alias("key"), F.col("kind").cast("int").alias("kind"), F.col("value").cast("binary").alias("value"))
        bad = F.col("key").isNull() | F.col("kind").isNull() | ~F.col("kind").isin(0, 1) | ((F.col("kind") == 1) & F.col("value").isNull())
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed = rows.repartitionByRange(n, "pos").sortWithinPartitions("pos").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"), bad.alias("bad"))
        path = f"{self.files.root}/{staging}"
        placed.write.mode("overwrite").parquet(path)
        placed = self.spark.read.schema(placed.schema).parquet(path)
        counts = {r["part"]: (r["n"], r["bad"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad")).collect()}
        if any(b for _, b in counts.values()):
            self.files.remove(staging)
            raise StoreError("a batch needs a key, a kind of 0 or 1, and a value for every put")
        at, offsets = self.state.last_seq + 1, {}
        for part in sorted(counts):
            offsets[part] = at
            at += counts[part][0]
        start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")] if offsets else F.lit(0)
        return placed.select("key", (start + F.col("i")).cast("long").alias("seq"), "kind", "value"), at - self.state.last_seq - 1

    def _write_segment(self, rows: DataFrame, num: int, level: int, count: int) -> File:
        name = f"{num:08d}-{uuid.uuid4().hex[:12]}"  # two writers may take the same number; only one's commit names its folder
        path = f"{self.files.root}/segments/{name}"
        size = rows.agg(F.sum(F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0] or 0
        pieces = max(1, -(-size // self.options.target_file_bytes))
        out = rows.repartitionByRange(pieces, "key") if pieces > 1 else rows.coalesce(1)
        writer = out.sortWithinPartitions(F.asc("key"), F.desc("seq")).write
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(path)
        m = self.spark.read.schema(SCHEMA).parquet(path).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"), F.max("seq").alias("t")).first()
        if m["n"] != count:
            raise Corruption(f"segment {num} has {m['n']} rows, {count} were written")
        parts = tuple((r["name"], r["length"], r["sha"]) for r in self._sums(name).collect())
        total = sum(x[1] for x in parts)
        self.counters["bytes_written"] += total
        return File(num, level, total, bytes(m["a"] or b""), bytes(m["b"] or b""), m["n"], m["s"] or 0, m["t"] or 0, size, name, parts)

    def _sums(self, name: str) -> DataFrame:
        """name, length and SHA-256 of a segment's parts."""
        raw = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.files.root}/segments/{name}")
        return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha"))

    # reads

    def log(self, state: State | None = None, start: bytes | None = None, end: bytes | None = None, seq: int | None = None) -> DataFrame:
        """All versions, from the files that may hold them: one scan over many paths."""
        self._live()
        files = scan_files(list((state or self.state).files), start, end, seq)
        self.counters["files_touched"] += len(files)
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return self._segments(files)

    def _segments(self, files: list[File]) -> DataFrame:
        """Rows of segments; Parquet's own page checksums are verified as pages are read."""
        read = self.spark.read.schema(SCHEMA).option("parquet.page.verify-checksum.enabled", "true")
        return read.parquet(*(f"{self.files.root}/segments/{f.name}" for f in files))

    @contextmanager
    def _reading(self, state: State, start: bytes | None, end: bytes | None, seq: int):
        """A read that fails over damaged segments raises Corruption; other failures pass as they are."""
        try:
            yield
        except NotFound:
            raise
        except Exception as e:
            try:
                self._verify(scan_files(list(state.files), start, end, seq))
            except Corruption as found:
                raise found from e
            raise

    def _scan(self, state: State, start, end, seq: int) -> DataFrame:
        return mvcc.scan(self.log(state, start, end, seq), start, end, seq).select("key", "value").orderBy("key")

    def _get(self, state: State, key: bytes, seq: int) -> bytes:
        self.counters["gets"] += 1
        with self._reading(state, key, key + b"\0", seq):
            row = mvcc.get(self.log(state, key, key + b"\0", seq), key, seq).first()
            if row is None:
                self._present(scan_files(list(state.files), key, key + b"\0", seq))
        if row is None:
            raise NotFound(key)
        return bytes(row["value"])

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self._scan(self.state, start, end, self.state.last_seq)

    def get(self, key: bytes) -> bytes:
        return self._get(self.state, key, self.state.last_seq)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return mvcc.multi_get(self.log(), keys, self.state.last_seq)

    def items(self, start: bytes | None = None, end: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Forward iteration, a partition at a time."""
        state = self.state
        with self._reading(state, start, end, state.last_seq):
            for r in self._scan(state, start, end, state.last_seq).toLocalIterator():
                yield bytes(r["key"]), bytes(r["value"])

    def snapshot(self) -> Snapshot:
        self._live()
        snap = Snapshot(self, self.state)
        self.snapshots.add(snap)
        return snap

    @property
    def last_seq(self) -> int:
        return self.state.last_seq

    # maintenance

    def flush(self) -> None:
        """A committed batch is a level-0 file already."""
        self._writable()

    def horizon(self) -> int:
        return min((s.seq for s in self.snapshots), default=self.state.last_seq)

    def compact_level(self, level: int) -> None:
        inputs = pick_inputs(list(self.state.files), level)
        lo, hi = min(f.smallest for f in inputs), max(f.largest for f in inputs)
        inputs += overlapping(list(self.state.files), level + 1, lo, hi)
        self._verify(inputs)
        merged = self._segments(inputs)
        if merged.count() != sum(f.count for f in inputs):
            raise Corruption("a compaction's inputs don't have the rows that the manifest says")
        num = self.state.next_file
        kept = mvcc.retain(merged, self.horizon(), bottom=level + 1 == self.options.levels - 1)
        count = kept.count()
        new = [self._write_segment(kept, num, level + 1, count)] if count else []
        self.state = self.manifest.commit(self.state, new, [f.num for f in inputs], self.state.last_seq, num + 1)
        self.counters["commits"] += 1

    def compact_until_quiet(self, most: int = 32) -> int:
        self._writable()
        for k in range(most):
            level = pick_level(list(self.state.files), self.options)
            if level < 0:
                return k
            self.compact_level(level)
        return most

    def compact_all(self) -> int:
        """As many compactions as are due; levels under their limits stay."""
        return self.compact_until_quiet()

    def collect_garbage(self, grace_s: float | None = None) -> list[str]:
        """Remove segments and temporary files that neither the state nor an open snapshot names, if older than grace_s (that of the options)."""
        self._writable()
        named = {f.name for s in (self.state, *(x.state for x in self.snapshots)) for f in s.files}
        return self._remove_unnamed(lambda: named, self.options.grace_s if grace_s is None else grace_s)

    def _remove_unnamed(self, named: Callable[[], set[str]], grace_s: float) -> list[str]:
        before = (time.time() - grace_s) * 1000
        age = lambda x: self.files.fs.getFileStatus(self.files.path(x)).getModificationTime()
        found = [f"{folder}/{name}" for folder in ("segments", "tmp") for name in self.files.names(folder)]
        live = {f.name for f in self.state.files}
        old = [x for x in found if x.removeprefix("segments/") not in live and age(x) <= before]
        keep = {f"segments/{n}" for n in named()} if old else set()
        removed = [x for x in old if x not in keep]
        for x in removed:
            self.files.remove(x)
        return removed

    def checksum_all(self) -> None:
        """Compare every part of every live segment with the manifest's SHA-256."""
        self._live()
        self._verify(list(self.state.files))

    def _present(self, files: list[File]) -> None:
        """A part that is gone reads as empty: before a key is called missing, the parts' names are compared."""
        for f in files:
            if {p[0] for p in f.parts} - set(self.files.names(f"segments/{f.name}")):
                raise Corruption(f"segment {f.num} lacks a part")

    def _verify(self, files: list[File]) -> None:
        for f in files:
            try:
                got = {(r["name"], r["length"], r["sha"]) for r in self._sums(f.name).collect()}
            except Exception as e:
                raise Corruption(f"segment {f.num} can't be read") from e
            if got != set(f.parts):
                raise Corruption(f"segment {f.num} differs from the manifest")

    # statistics and life cycle

    def manifest_table(self) -> DataFrame:
        rows = [(f.num, f.level, f.size, f.smallest, f.largest, f.count, f.min_seq, f.max_seq) for f in self.state.files]
        return self.spark.createDataFrame(rows, "num long, level int, size long, smallest binary, largest binary, count long, min_seq long, max_seq long")

    def stats(self) -> dict:
        files, c = self.state.files, self.counters
        live = sum(f.size for f in files)
        level = deepest(list(files))
        return c | {
            "last_seq": self.state.last_seq, "l0_files": sum(f.level == 0 for f in files), "live_bytes": live, "deepest_level": level, "write_amp": c["bytes_written"] / c["bytes_in"] if c["bytes_in"] else 0.0,
            "space_amp": live / c["bytes_in"] if c["bytes_in"] else 0.0, "read_amp": c["files_touched"] / c["gets"] if c["gets"] else 0.0, "write_amp_model": write_amp_model(level),
        }

    def debug_string(self) -> str:
        return "\n".join(f"L{f.level} {f.num:08d} {f.size} bytes, {f.count} rows, seq {f.min_seq}-{f.max_seq}" for f in self.state.files)

    def close(self) -> None:
        self.closed = True
        self.snapshots.clear()

    def _live(self) -> None:
        if self.closed:
            raise Closed("store is closed")

    def _writable(self) -> None:
        self._live()
        if self.options.read_only:
            raise ReadOnly("store is read-only")


__all__ = ["Batch", "BatchTooLarge", "Closed", "NotFound", "Options", "ReadOnly", "Snapshot", "Store"]
