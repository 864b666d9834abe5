"""Which files a compaction takes. Pure functions over file metadata, and the same as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class File:
    num: int
    level: int
    size: int
    smallest: bytes
    largest: bytes
    count: int
    min_seq: int
    max_seq: int
    bytes_in: int = 0
    name: str = ""
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Options:
    l0_trigger: int = 4
    level_base: int = 10 << 20
    multiplier: int = 10
    levels: int = 7
    target_file_bytes: int = 256 << 20
    auto_compact: bool = True
    bloom: bool = True
    read_only: bool = False
    checkpoint_every: int = 32
    sync: bool = True
    max_batch_bytes: int = 1 << 30
    grace_s: float = 6 * 3600.0


def pick_level(files: list[File], options: Options = Options()) -> int:
    """0 when it has trigger files; else the first level over its size; else -1. The last level is never picked."""
    if sum(f.level == 0 for f in files) >= options.l0_trigger:
        return 0
    for level in range(1, options.levels - 1):
        if sum(f.size for f in files if f.level == level) >= options.level_base * options.multiplier ** (level - 1):
            return level
    return -1


def pick_inputs(files: list[File], level: int) -> list[File]:
    """All files of level 0, the one with the smallest key of another level."""
    own = sorted((f for f in files if f.level == level), key=lambda f: (f.smallest, f.num))
    return own if level == 0 else own[:1]


def overlapping(files: list[File], level: int, lo: bytes, hi: bytes) -> list[File]:
    """Files of a level that meet the closed key interval."""
    return [f for f in files if f.level == level and not (f.largest < lo or f.smallest > hi)]


def scan_files(files: list[File], start: bytes | None, end: bytes | None, seq: int | None = None) -> list[File]:
    """Files that may hold keys of [start, end) as of seq."""
    return [f for f in files if not (start is not None and f.largest < start) and not (end is not None and f.smallest >= end) and not (seq is not None and f.min_seq > seq)]


def deepest(files: list[File]) -> int:
    return max((f.level for f in files), default=0)


def write_amp_model(level: int) -> float:
    """Writes of a byte that sinks to a level: log and first file, then ten for each level below the first."""
    return 2.0 + 10.0 * (max(level, 1) - 1)


def file_meta(log: DataFrame, rows: int) -> DataFrame:
    """Metadata of segments of so many consecutive sequence numbers."""
    return log.groupBy(F.floor((F.col("seq") - 1) / rows).cast("long").alias("file")).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def files_in_range(files: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        files = files.where(F.col("largest") >= F.lit(start))
    return files if end is None else files.where(F.col("smallest") < F.lit(end))
