import random

from pyspark.sql import functions as F

from palimpsest.functions.codec import MembershipFilter, crc32c, crc32c_all, crc32c_column, internal_key, internal_order, split_internal_key


def test_crc32c(spark):
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"a") != crc32c(b"b")
    df = spark.createDataFrame([(b"123456789",), (None,)], "b binary").select(crc32c_column("b").alias("c"))
    assert {r["c"] for r in df.collect()} == {0xE3069283, None}


def test_internal_key(spark):
    rows = [(b"a", 1, 1), (b"a", 5, 0), (b"", 2**56 - 1, 1), (b"\xff\x00", 7, 1)]
    df = spark.createDataFrame(rows, "key binary, seq long, kind int")
    ik = df.withColumn("ik", internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    k, s, n = split_internal_key(F.col("ik"))
    assert sorted((bytes(r[0]), r[1], r[2]) for r in ik.select(k, s, n).collect()) == sorted(rows)
    assert [(bytes(r["key"]), r["seq"]) for r in df.orderBy(*internal_order()).collect()] == [(b"", 2**56 - 1), (b"a", 5), (b"a", 1), (b"\xff\x00", 7)]


def test_membership_filter():
    keys = [i.to_bytes(2, "big") for i in range(10_000)]
    f = MembershipFilter(keys)
    assert all(f.might_contain(k) for k in random.Random(1).sample(keys, 2000))
    wrong = sum(f.might_contain((2**20 + i).to_bytes(3, "big")) for i in range(10_000))
    assert wrong <= 1.2 * f.expected_rate(len(keys)) * 10_000
    assert MembershipFilter([]).might_contain(b"any")


def test_crc_of_many_is_that_of_each():
    rng = random.Random(5)
    data = [rng.randbytes(rng.randrange(40)) for _ in range(300)] + [b"", b"123456789", rng.randbytes(3000)]
    assert crc32c_all(data).tolist() == [crc32c(b) for b in data]
    assert crc32c_all([]).tolist() == [] and crc32c_all([b""]).tolist() == [0]
