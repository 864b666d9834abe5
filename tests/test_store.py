"""The store: durability, atomicity, snapshots, compaction, corruption, crashes."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from palimpsest.operators.compaction import File, Options, deepest, overlapping, pick_inputs, pick_level, scan_files, write_amp_model
from palimpsest.plans.manifest import Conflict, Corruption, Files, StoreError
from palimpsest.plans.store import Batch, BatchTooLarge, Closed, NotFound, ReadOnly, Store
from palimpsest.streaming.ingest import file_stream, ingest

QUIET = Options(auto_compact=False)


def kv(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def batch(n, value, keys="k%03d"):
    b = Batch()
    for i in range(n):
        b.put((keys % i).encode(), value)
    return b


def test_basics(spark, tmp_path):
    s = Store(spark, str(tmp_path), QUIET)
    assert s.write(Batch()) == 0
    assert s.write(Batch().put(b"a", b"1").put(b"b", b"2").put(b"a", b"3").delete(b"c")) == 4
    s.put(b"", b"")
    s.delete(b"b")
    assert kv(s.scan()) == {b"": b"", b"a": b"3"}
    assert s.get(b"a") == b"3"
    for k in (b"b", b"c", b"zz"):
        with pytest.raises(NotFound):
            s.get(k)
    assert list(s.items(b"a")) == [(b"a", b"3")]
    again = Store(spark, str(tmp_path), QUIET)
    assert kv(again.scan()) == {b"": b"", b"a": b"3"}
    assert again.last_seq == 6
    with pytest.raises(StoreError):
        s.write(spark.createDataFrame([(0, None, 1, b"x")], "pos long, key binary, kind int, value binary"))
    s.close()
    s.close()
    for f in (s.scan, s.snapshot, s.flush, s.checksum_all, lambda: s.put(b"x", b"y")):
        with pytest.raises(Closed):
            f()
    assert s.write(Batch()) == 6


def test_read_only(spark, tmp_path):
    with pytest.raises(ReadOnly):
        Store(spark, str(tmp_path / "none"), Options(read_only=True))
    Store(spark, str(tmp_path), QUIET).put(b"a", b"1")
    s = Store(spark, str(tmp_path), Options(read_only=True))
    assert s.get(b"a") == b"1"
    for f in (lambda: s.put(b"b", b"2"), s.flush, s.compact_all, s.collect_garbage):
        with pytest.raises(ReadOnly):
            f()


def test_snapshot_survives_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(l0_trigger=2, auto_compact=False))
    s.write(batch(30, b"old"))
    snap = s.snapshot()
    s.write(batch(30, b"new"))
    s.delete(b"k000")
    frozen = snap.scan()
    s.compact_all()
    s.collect_garbage(0.0)
    assert set(kv(frozen).values()) == set(kv(snap.scan()).values()) == {b"old"}
    assert snap.get(b"k000") == b"old"
    assert len(kv(s.scan())) == 29
    assert sum(f.count for f in s.state.files) == 61
    snap.release()
    snap.release()
    with pytest.raises(Closed):
        snap.scan()
    s.write(batch(1, b"x", "z%03d"))
    s.compact_all()
    assert s.collect_garbage(0.0)
    s.checksum_all()
    stats = s.stats()
    assert stats["deepest_level"] == 1 and stats["write_amp"] > 0 and stats["write_amp_model"] == 2.0
    assert s.manifest_table().count() == len(s.state.files) and "L1" in s.debug_string()


def test_last_level_drops_deletes(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(l0_trigger=2, levels=2, auto_compact=False))
    s.write(batch(4, b"v"))
    s.delete(b"k001")
    s.compact_all()
    assert [f.count for f in s.state.files] == [3]
    assert len(kv(s.scan())) == 3


def test_model(spark, tmp_path):
    rng, model = random.Random(7), {}
    s = Store(spark, str(tmp_path), Options(l0_trigger=3, checkpoint_every=4))
    for _ in range(7):
        b = Batch()
        for _ in range(60):
            key = b"k%05d" % rng.randrange(80)
            if rng.random() < 0.2:
                b.delete(key)
                model.pop(key, None)
            else:
                value = b"%d" % rng.randrange(10**6)
                b.put(key, value)
                model[key] = value
        s.write(b)
    assert kv(s.scan()) == model
    assert kv(Store(spark, str(tmp_path)).scan()) == model
    lo, hi = b"k00020", b"k00050"
    assert kv(s.scan(lo, hi)) == {k: v for k, v in model.items() if lo <= k < hi}


class Failing(Files):
    """Fails at the n-th publish, before or after the rename."""

    def arm(self, n, after):
        self.left, self.after = n, after
        return self

    def publish(self, name, data):
        self.left -= 1
        if self.left == 0 and not self.after:
            raise OSError("crash before publish")
        super().publish(name, data)
        if self.left == 0:
            raise OSError("crash after publish")


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_crash_at_publish(spark, tmp_path, n, after):
    acked, tried = [], []
    try:
        s = Store(spark, str(tmp_path), Options(l0_trigger=2), Failing(spark, str(tmp_path)).arm(n, after))
        for i in range(3):
            tried.append(i)
            s.write(Batch().put(b"a%d" % i, b"1").put(b"b%d" % i, b"2"))
            acked.append(i)
    except OSError:
        pass
    if n == 1 and not after:
        shutil.rmtree(tmp_path / "segments", ignore_errors=True)  # nothing was published: an empty folder
    got = kv(Store(spark, str(tmp_path)).scan())
    for i in range(3):
        whole = {b"a%d" % i, b"b%d" % i} & set(got)
        assert len(whole) in (0, 2)
        assert i not in acked or len(whole) == 2
        assert i in tried or not whole


def test_conflict(spark, tmp_path):
    a = Store(spark, str(tmp_path), QUIET)
    b = Store(spark, str(tmp_path), QUIET)
    a.put(b"x", b"1")
    with pytest.raises(Conflict):
        b.put(b"y", b"2")
    assert kv(Store(spark, str(tmp_path)).scan()) == {b"x": b"1"}


def test_damage_is_found(spark, tmp_path):
    s = Store(spark, str(tmp_path), QUIET)
    s.write(batch(60, b"v"))
    part = next((tmp_path / "segments").glob("*/*.parquet"))
    crc = part.with_name(f".{part.name}.crc")
    good = part.read_bytes()
    for at in random.Random(3).sample(range(len(good)), 4):
        crc.unlink(missing_ok=True)
        part.write_bytes(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
        with pytest.raises(Corruption):
            s.checksum_all()
    part.write_bytes(good)
    s.checksum_all()
    commit = sorted((tmp_path / "manifest").glob("*.json"))[-1]
    text = commit.read_bytes()
    commit.with_name(f".{commit.name}.crc").unlink(missing_ok=True)
    for at in (5, len(text) // 2, len(text) - 3):
        commit.write_bytes(text[:at] + bytes([text[at] ^ 1]) + text[at + 1 :])
        with pytest.raises(Corruption):
            Store(spark, str(tmp_path))
    commit.write_bytes(text)
    shutil.rmtree(next((tmp_path / "segments").iterdir()))
    with pytest.raises(Corruption):
        Store(spark, str(tmp_path))
    shutil.rmtree(tmp_path / "manifest")
    (tmp_path / "segments" / "00000001").mkdir()
    with pytest.raises(Corruption):
        Store(spark, str(tmp_path))


def test_damage_on_read(spark, tmp_path):
    s = Store(spark, str(tmp_path), QUIET)
    s.write(batch(60, b"v"))
    part = next((tmp_path / "segments").glob("*/*.parquet"))
    good = part.read_bytes()
    part.with_name(f".{part.name}.crc").unlink()
    for bad in (good[:40] + bytes(20) + good[60:], good[: len(good) // 2], None):
        part.write_bytes(bad) if bad else part.unlink()
        with pytest.raises(Corruption):
            s.get(b"k007")
        if bad:
            with pytest.raises(Corruption):
                list(s.items())
    part.write_bytes(good)
    assert s.get(b"k007") == b"v"
    with pytest.raises(NotFound):
        s.get(b"none")


def test_limits_and_orphans(spark, tmp_path):
    options = Options(auto_compact=False, max_batch_bytes=4, checkpoint_every=2, sync=False, grace_s=0.0)
    s = Store(spark, str(tmp_path), options)
    with pytest.raises(BatchTooLarge):
        s.put(b"abc", b"de")
    assert s.last_seq == 0
    for n in (3, 1, 3, 5):
        s.write(Batch().put(b"a", b"%d" % n), batch_id=("q", n))
    s.write(Batch().put(b"b", b"x"), batch_id="once")
    s.write(Batch().put(b"b", b"y"), batch_id="once")
    assert s.state.marks == (("q", 5),) and s.state.batches == ("once",) and s.last_seq == 3
    s.put(b"c", b"z")
    assert len(list((tmp_path / "manifest").glob("*.json"))) < s.state.version
    (tmp_path / "segments" / "00000099-orphan").mkdir()
    (tmp_path / "tmp" / "left").mkdir()
    kept = Store(spark, str(tmp_path), QUIET)
    assert (tmp_path / "segments" / "00000099-orphan").exists()
    assert kv(kept.scan()) == {b"a": b"5", b"b": b"x", b"c": b"z"} and kept.state == s.state
    assert kv(Store(spark, str(tmp_path), options).scan()) == {b"a": b"5", b"b": b"x", b"c": b"z"}
    assert not (tmp_path / "segments" / "00000099-orphan").exists() and not (tmp_path / "tmp" / "left").exists()


def test_pickers():
    f = lambda num, level, size, lo, hi: File(num, level, size, lo, hi, 1, num, num)
    files = [f(1, 0, 5, b"a", b"c"), f(2, 0, 5, b"b", b"d"), f(3, 1, 30, b"a", b"b"), f(4, 1, 30, b"d", b"f"), f(5, 2, 5, b"x", b"z")]
    assert pick_level(files, Options(l0_trigger=3)) == -1
    assert pick_level(files, Options(l0_trigger=2)) == 0
    assert pick_level(files, Options(l0_trigger=3, level_base=50)) == 1
    assert [x.num for x in pick_inputs(files, 0)] == [1, 2] and [x.num for x in pick_inputs(files, 1)] == [3]
    assert [x.num for x in overlapping(files, 1, b"b", b"d")] == [3, 4]
    assert [x.num for x in scan_files(files, b"d", b"x")] == [2, 4]
    assert [x.num for x in scan_files(files, None, b"")] == []
    assert deepest(files) == 2 and write_amp_model(3) == 22.0


def test_stream_is_exactly_once(spark, tmp_path):
    schema = "pos long, key binary, kind int, value binary"
    for i in range(3):
        spark.createDataFrame([(j, b"k%d" % j, 1, b"%d" % i) for j in range(4)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "store"), QUIET)
    ingest(file_stream(spark, str(tmp_path / "in"), schema), s, str(tmp_path / "cp")).awaitTermination()
    assert s.last_seq == 12 and len(kv(s.scan())) == 4
    df = spark.createDataFrame([(0, b"k0", 1, b"again")], schema)
    assert s.write(df, batch_id=("ingest", 0)) == 12


CHILD = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from palimpsest.plans.store import Batch, Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
s = Store(spark, {root!r})
for i in range(1000):
    s.put(b"k%08d" % i, b"v%08d" % i)
    print("acked", i, flush=True)
"""


def test_killed_writer(spark, tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    child = subprocess.Popen([sys.executable, "-c", CHILD.format(repo=repo, root=str(tmp_path))], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    acked = -1
    for line in child.stdout:
        if line.startswith("acked"):
            acked = int(line.split()[1])
        if acked >= 4:
            break
    child.kill()
    child.wait()
    got = kv(Store(spark, str(tmp_path), QUIET).scan())
    assert all(got[b"k%08d" % i] == b"v%08d" % i for i in range(acked + 1))
