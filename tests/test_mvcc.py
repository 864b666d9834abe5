"""Reads and retention over the micro fixture, and against a model."""

import random

import pytest

from palimpsest.operators import mvcc

LOG = [
    (b"a", 1, 1, b"a1"), (b"b", 2, 1, b"b1"), (b"a", 3, 1, b"a2"), (b"c", 4, 1, b""), (b"b", 5, 0, None), (b"a", 6, 0, None),
    (b"d", 7, 0, None), (b"a", 8, 1, b"a3"), (b"", 9, 1, b"e1"), (b"\xff", 10, 1, b"ff"),
]
SCHEMA = "key binary, seq long, kind int, value binary"


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, SCHEMA)


def kv(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.orderBy("key").collect()]


@pytest.mark.parametrize(
    ("start", "end", "seq", "expected"),
    [
        (None, None, None, [(b"", b"e1"), (b"a", b"a3"), (b"c", b""), (b"\xff", b"ff")]),
        (None, None, 4, [(b"a", b"a2"), (b"b", b"b1"), (b"c", b"")]),
        (None, None, 6, [(b"c", b"")]),
        (None, None, 0, []),
        (b"a", b"c", None, [(b"a", b"a3")]),
        (None, b"b", None, [(b"", b"e1"), (b"a", b"a3")]),
        (b"c", None, None, [(b"c", b""), (b"\xff", b"ff")]),
        (None, b"", None, []),
        (b"c", b"a", None, []),
    ],
)
def test_scan(log, start, end, seq, expected):
    assert kv(mvcc.scan(log, start, end, seq)) == expected
    wide = mvcc.newest_wide(mvcc.as_of(mvcc.in_range(log, start, end), seq)).where("kind = 1")
    assert kv(wide) == expected


@pytest.mark.parametrize(
    ("horizon", "bottom", "expected"),
    [(6, False, [4, 5, 6, 7, 8, 9, 10]), (6, True, [4, 6, 7, 8, 9, 10]), (10, False, [4, 5, 7, 8, 9, 10]), (10, True, [4, 8, 9, 10])],
)
def test_retain(log, horizon, bottom, expected):
    kept = mvcc.retain(log, horizon, bottom)
    assert sorted(r["seq"] for r in kept.collect()) == expected
    assert sorted(r["seq"] for r in mvcc.dropped(log, horizon, bottom).collect()) == sorted({*range(1, 11)} - {*expected})
    for s in range(horizon, 11):
        assert kv(mvcc.scan(kept, seq=s)) == kv(mvcc.scan(log, seq=s))


def test_reads(spark, log):
    assert kv(mvcc.get(log, b"a")) == [(b"a", b"a3")]
    assert kv(mvcc.get(log, b"b")) == []
    assert kv(mvcc.get(log, b"b", 4)) == [(b"b", b"b1")]
    keys = spark.createDataFrame([(b"a",), (b"b",), (b"zz",), (b"a",)], "key binary")
    got = sorted((bytes(r["key"]), r["found"], r["value"] and bytes(r["value"])) for r in mvcc.multi_get(log, keys).collect())
    assert got == [(b"a", 1, b"a3"), (b"a", 1, b"a3"), (b"b", 0, None), (b"zz", 0, None)]
    assert {bytes(r["key"]) for r in mvcc.tombstones(log).collect()} == {b"b", b"d"}
    assert [r["seq"] for r in mvcc.history(log, b"a").collect()] == [8, 6, 3, 1]
    got = {bytes(r["key"]): r["change"] for r in mvcc.diff(log, 4).collect()}
    assert got == {b"a": "changed", b"b": "removed", b"": "added", b"\xff": "added"}


def test_model(spark):
    rng = random.Random(99)
    rows, model, states = [], {}, {}
    for seq in range(1, 1201):
        key = b"k%05d" % rng.randrange(400)
        if rng.random() < 0.2:
            model.pop(key, None)
            rows.append((key, seq, 0, None))
        else:
            model[key] = b"v%05d" % seq
            rows.append((key, seq, 1, model[key]))
        states[seq] = dict(model)
    log = spark.createDataFrame(rows, SCHEMA).cache()
    for seq in (300, 900, 1200):
        for start, end in ((None, None), (b"k00050", b"k00150"), (b"k00100", None), (None, b"k00010"), (b"k99999", None)):
            want = sorted((k, v) for k, v in states[seq].items() if (start is None or k >= start) and (end is None or k < end))
            assert kv(mvcc.scan(log, start, end, seq)) == want


def test_empty(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert mvcc.scan(log).count() == mvcc.retain(log, 5, True).count() == mvcc.diff(log, 1).count() == 0
    assert mvcc.amplification(log).first()["space_amp"] == 0
