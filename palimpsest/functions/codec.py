"""Keys, checksums and membership filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_SEQ = (1 << 56) - 1
DELETE, VALUE = 0, 1


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """User key and a big-endian 8-byte trailer that holds seq and kind."""
    trailer = F.unhex(F.lpad(F.hex(F.shiftleft(seq.cast("long"), 8) + kind.cast("long")), 16, "0"))
    return F.concat(key.cast("binary"), trailer)


def split_internal_key(ikey: Column) -> tuple[Column, Column, Column]:
    """(key, seq, kind) of an internal key; fails on fewer than 8 bytes."""
    n = F.octet_length(ikey)
    checked = F.when(n >= 8, ikey).otherwise(F.raise_error(F.lit("internal key shorter than its trailer")).cast("binary"))
    trailer = F.conv(F.hex(checked.substr(n - 7, F.lit(7))), 16, 10).cast("long")
    return checked.substr(F.lit(1), n - 8), trailer, F.conv(F.hex(checked.substr(n, F.lit(1))), 16, 10).cast("int")


def internal_order(key: str = "key", seq: str = "seq", kind: str = "kind") -> list[Column]:
    """Keys ascending as unsigned bytes, newest version first."""
    return [F.col(key).asc(), F.col(seq).desc(), F.col(kind).desc()]


def _castagnoli() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _castagnoli()


def crc32c(data: bytes, before: int = 0) -> int:
    """CRC-32C (Castagnoli), continued from the checksum of what came before. Spark's crc32 is the IEEE one."""
    c = before ^ 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _TABLE[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


_STEPS = np.array(_TABLE, np.uint32)


def crc32c_all(data: list[bytes]) -> np.ndarray:
    """The checksums of many strings: a step takes one byte of every string that is long enough.

    Strings go in by falling length, so those that a step still concerns are a prefix; no padding is stored.
    """
    sizes = np.fromiter((len(b) for b in data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8)
    starts, falling = (np.cumsum(sizes) - sizes)[order], -sizes[order]
    c = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(falling, -i, "left"))  # strings of more than i bytes
        if n < 16:  # too few to be worth a step: the rest of each, byte by byte
            for k in range(n):
                c[k] = crc32c(data[order[k]][i:], int(c[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        c[:n] = c[:n] >> np.uint32(8) ^ _STEPS[(c[:n] ^ flat[starts[:n] + i]) & np.uint32(255)]
    out = np.empty(len(data), np.int64)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    known = data.notna()
    out = pd.Series(None, index=data.index, dtype="Int64")
    out[known] = crc32c_all([bytes(b) for b in data[known]])
    return out


class MembershipFilter:
    """A Bloom filter over keys: no false negatives; an empty one answers 'maybe' to all."""

    def __init__(self, keys: list[bytes], bits_per_key: int = 10):
        self.size = max(64, len(keys) * bits_per_key)
        self.probes = min(30, max(1, round(bits_per_key * np.log(2)))) if keys else 0
        self.bits = np.zeros(self.size, bool)
        for k in keys:
            self.bits[self._places(k)] = True

    def _places(self, key: bytes) -> np.ndarray:
        import hashlib

        blocks = (hashlib.blake2b(key, digest_size=64, salt=bytes([i])).digest() for i in range(-(-self.probes // 8)))
        return (np.frombuffer(b"".join(blocks), np.uint64)[: self.probes] % np.uint64(self.size)).astype(np.int64)

    def might_contain(self, key: bytes) -> bool:
        return not self.probes or bool(self.bits[self._places(key)].all())

    def expected_rate(self, keys: int) -> float:
        return (1 - np.exp(-self.probes * keys / self.size)) ** self.probes
