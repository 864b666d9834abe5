"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents are tokenised and cut into pieces; full pieces are sequences of their own. The others
are dealt to partitions of bounded size and packed by best-fit decreasing. For every partition
dual feasible functions give a lower bound on its bins. A partition whose bins meet its bound is
certified: no packing of its pieces has fewer, its bins are closed and it is never opened again, but
for its emptiest bin, which is the rounding of its bound. A partition with a gap (more bins than its
bound) closes its full bins only. The pieces of the others, and of the certified ones' emptiest bins,
are exchanged: dealt anew to as many partitions as they need, and packed again. It ends when the
count meets the bound of the whole table's histogram of lengths (at most ``capacity`` rows), when one
partition holds all that is left, or when a round closes too little.

Defined results: a null or empty text is one piece that holds only the end token; a repeated or
null id is packed once per row; of equal lengths any order will do; a long text is tokenised whole,
by one task; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts
from .token_counts import load

CAPACITY = 2048
END_ID = 0
GROUP = 8192
ROUNDS = 8
#: Groups that are placed by range, so that each has a task of its own; more are hashed.
RANGED = 256
#: Words of a worker's cache at most; it is emptied beyond.
CACHE = 1 << 19

#: Characters for which lower() and the tokenizer's normaliser agree one by one and NFC changes nothing.
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-¬®-ÿŒœ–—‘-„…€]*")
#: The pre-tokenizer's pattern, written for those characters in lower case.
_CONTRACTION = "'(?:[stmd]|re|ve|ll)"
_ASCII_WORDS = re.compile(rf"{_CONTRACTION}|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿœ", "0-9²³¹¼-¾"
_WORDS = re.compile(rf"{_CONTRACTION}|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")


class WordIds(dict):
    """Packed ids of a word, by the library itself, kept for the words seen before."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        return out


def word_splitting(tok) -> bool:
    """Whether the tokenizer has the lower-casing word splitter that WordIds relies on."""
    import json

    spec = json.loads(tok.to_str())
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return kinds == ["NFC", "Replace", "Lowercase"] and (split.get("pattern") or {}).get("Regex") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def ids_of(tok, cache: WordIds | None, text: str) -> bytes:
    """Little-endian 32-bit ids. Texts of plain characters go word by word, others as a whole."""
    if cache is not None and "<|" not in text:
        if text.isascii():
            if not text.encode().translate(None, _ASCII):
                return b"".join([cache[w] for w in _ASCII_WORDS.findall(text.lower())])
        elif _PLAIN.fullmatch(text):
            return b"".join([cache[w] for w in _WORDS.findall(text.lower())])
    return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most capacity tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer_path)
        cache = WordIds(tok) if word_splitting(tok) else None
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(tok, cache, text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual feasible functions, over a histogram of lengths.

    Identity: total over capacity. f_e, for each e up to half the capacity: items over C - e count
    as whole bins, those under e as nothing, the others as they are. u_k, for k up to 20: an item
    x counts floor((k+1)x/C)/k, or x/C where (k+1)x/C is whole.
    """
    if not len(lengths):
        return 0
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    order = np.argsort(x)
    x, n = x[order], n[order]
    items, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(x * n)])
    for e in np.unique(np.concatenate([x[x <= capacity // 2], capacity - x[x > capacity // 2] + 1, [1]])):
        if 2 * e > capacity:
            continue
        low, high = np.searchsorted(x, e, "left"), np.searchsorted(x, capacity - e, "right")
        best = max(best, int(items[-1] - items[high]) + -(-int(mass[high] - mass[low]) // capacity))
    for k in range(1, 21):
        q, whole = np.divmod((k + 1) * x, capacity)
        value = np.where(whole == 0, x * k, q * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds. A bit set of residuals finds the tightest bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, some = [], 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if fit := some >> need:
            r = need + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = left = r - need
        if left:
            by_room[left].append(b)
            some |= 1 << left
    return bins, offsets, capacity - np.asarray(room, np.int64)


PACKED = "dealt long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean, round int, part_bins long, part_bound long"


def _pack_round(pool: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """A round: deal pool to groups, pack each. sequence_id holds round, group and bin in bits 58-61, 20-57 and 0-19."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, held = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        sizes, counts = np.unique(pdf["length"].to_numpy(), return_counts=True)
        base = (round_no << 58) | (int(pdf["_group"].iloc[0]) << 20)
        bound = lower_bound(sizes, counts, capacity)
        closed = held == capacity
        if len(held) <= bound:  # certified
            closed |= np.arange(len(held)) != held.argmin()
        out = pdf.drop(columns="_group").assign(sequence_id=base + bins, offset=offsets, closed=closed[bins], round=round_no, part_bins=len(held), part_bound=bound)
        return out.astype({"piece": "int32", "round": "int32"})

    salt = F.pmod(F.xxhash64(F.lit(round_no), "dealt"), F.lit(groups)).cast("int")
    pool = pool.withColumn("_group", salt)
    if groups <= RANGED:  # a few groups would meet in the same task by their hashes
        pool = pool.repartitionByRange(4 * groups, "_group")
    return pool.groupBy("_group").applyInPandas(pack, PACKED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Every piece with its sequence and its place there.

    A group holds about ``group`` pieces, whatever the input's size. Rounds shrink the pool by what
    they close; a group's open bins are few where small pieces abound, so the pool falls by orders
    of magnitude a round.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    # numbered once, so that equal rows are dealt apart
    cut = scratch.table(pieces(docs, tokenizer_path, capacity, end_id).withColumn("dealt", F.monotonically_increasing_id()), "pieces")
    sizes = cut.groupBy("length").count().toPandas()  # capacity rows at most
    bound = lower_bound(sizes["length"].to_numpy(), sizes["count"].to_numpy(), capacity)
    full = cut.where(F.col("length") == capacity)
    numbered = full.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + F.lit(-(1 << 62))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("closed"), F.lit(-1).alias("round"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound")
    )
    done, pool = [numbered], cut.where(F.col("length") < capacity)
    closed_bins, left = int(sizes.loc[sizes["length"] == capacity, "count"].sum()), int(sizes.loc[sizes["length"] < capacity, "count"].sum())
    for k in range(rounds):
        if not left:
            break
        groups = -(-left // group)
        packed = scratch.table(_pack_round(pool, groups, k, capacity), f"round{k}")
        got = packed.where("offset = 0").groupBy("closed").count().collect()
        bins = {r["closed"]: r["count"] for r in got}
        still = packed.where("not closed").count()
        if closed_bins + sum(bins.values()) <= bound or groups == 1 or k == rounds - 1 or still > 0.9 * left:
            done.append(packed.drop("dealt"))
            break
        done.append(packed.where("closed").drop("dealt"))
        closed_bins += bins.get(True, 0)
        pool, left = packed.where("not closed").select("dealt", "doc_id", "piece", "start", "length", "ids_crc32"), still
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("total_bound", F.lit(bound).cast("long"))
