"""Near duplicates: MinHash bands for candidates, odd sketches to screen them, full sets to confirm.

1. Rows with equal texts form a class, found by a partial aggregate over a text digest.
2. For a member of each class the distinct shingles are hashed (64 bits). ``HASHES`` minimum values
   under as many permutations make bands of ``BAND_ROWS``, whose keys are the buckets. ``SAMPLES`` more
   MinHash samples come from one permutation (the smallest hash in each of so many bins, empty bins
   left out) and are folded into an odd sketch: each flips a bit of ``SKETCH_BITS``.
3. In a bucket, every member meets the bucket's smallest one. The population count of the XOR of
   two sketches estimates the samples' difference. ``screen`` gives the count that a pair at the
   threshold has, from the sizes of the two sets alone, ``DEVIATIONS`` standard deviations up; pairs
   beyond it go. The rest are confirmed on the full sets.
4. Links are contracted to components by hooking and pointer jumping, on the executors.
5. Members of a bucket that are still in different components meet a member of the bucket's main
   component, a few rounds long, and at last every such pair is screened by sizes and sketches, and
   what passes is confirmed on the full sets, inside the join's condition: what the join makes is
   links only, however many pairs fail. Only pairs inside one component are skipped; that they are
   linked is known already.

A hot bucket is never one task's: pivots and main components come from partial aggregates that are
written, and what joins them are plain scans, which Spark can split. Set comparisons run as a
sorted stream (a pivot's set, then up to ``STAR`` partners), so a task holds two sets.

A pair at the threshold shares no band with probability (1 - 0.75^4)^40, about 3e-7.

Defined results: null, empty or blank texts have no shingles and link with nothing; repeated rows
are copies of each other; rows that share a doc_id count as one document; a row with a null doc_id
takes no part (n_shingles as counted, component_id null, kept true).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, numbered, texts, without

WORDS = 5
THRESHOLD = (3, 4)  # 0.75, exactly
BANDS, BAND_ROWS = 40, 4
HASHES = BANDS * BAND_ROWS
SAMPLES = 1024
SKETCH_BITS = 2048
LANES = SKETCH_BITS // 64
DEVIATIONS = 5.0
STAR = 64
PIVOT_ROUNDS = 3
#: Words of a worker's cache at most; it is emptied beyond.
CACHE = 1 << 17

_RNG = np.random.default_rng(20240229)
_WORD_MULT = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_MULT = _RNG.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND = _RNG.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, seen: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words of a text's bytes. bytes.lower and bytes.split
    are exactly A-Z and the six white-space characters of the contract."""
    got = text.lower().split() if text else []
    if not got:
        return np.empty(0, np.uint64)
    w = np.array([seen[x] for x in got], np.uint64)
    mult = _WORD_MULT if words == WORDS else np.random.default_rng(words).integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)
    if len(w) < words:
        return _mix((w * mult[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    h = np.zeros(len(w) - words + 1, np.uint64)
    for j in range(words):
        h += w[j : len(w) - words + 1 + j] * mult[j]
    return np.unique(_mix(h))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value under each of HASHES permutations of 32-bit numbers; long sets in parts."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (_MULT[:, None] * x[None, at : at + 4096] + _ADD[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """LANES 64-bit words of a sorted set of hashes: the smallest hash of each of SAMPLES bins flips one bit."""
    low, full = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, bool)
    bins = (hashes & np.uint64(SAMPLES - 1)).astype(np.int64)
    low[bins[::-1]] = hashes[::-1]  # of several values for a bin the last one stays: the smallest
    full[bins] = True
    bits = (_mix(low[full]) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def screen(na, nb, exp=np.exp, sqrt=np.sqrt):
    """XOR bits of two sketches beyond which sets of these sizes can't be at the threshold.

    At similarity t the union has u = (na + nb) / (1 + t) elements. Its smallest ones by bin are a
    random subset, of U = k (1 - e^(-u/k)) elements, of which the share t is common: without
    replacement, so the count's variance is U t (1 - t) (1 - U/u). m differing samples set
    n/2 (1 - e^(-2m/n)) bits. Takes numbers, or columns with their functions.
    """
    k, n, t = float(SAMPLES), float(SKETCH_BITS), THRESHOLD[0] / THRESHOLD[1]
    union = (na + nb) / (1 + t)
    full = k * (1 - exp(-union / k))
    differ = k * (2 - exp(-na / k) - exp(-nb / k)) - 2 * t * full
    spread = 4 * t * (1 - t) * full * (1 - full / union)
    slope = exp(-2 * differ / n)
    variance = slope * slope * spread + n / 4 * (1 - slope * slope) - differ * slope * slope
    return n / 2 * (1 - slope) + DEVIATIONS * sqrt(variance + 1) + 2


def band_keys(samples: np.ndarray) -> np.ndarray:
    s = samples.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    return _mix((s * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays or [np.empty(0, np.uint64)]).view(np.int64)))


SIGNATURE = "doc_id long, key binary, n long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, text as binary), the text replaced by its number of shingles, band keys and odd sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = _WordHash(), {}
        for batch in batches:
            n, bands, sketches = [], [], []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key not in last:  # copies that stand near each other are signed once
                    if len(last) >= 4096:
                        last.clear()
                    h = shingles(text.as_py(), seen)
                    last[key] = (len(h), band_keys(min_hashes(h)) if len(h) else np.empty(0, np.uint64), odd_sketch(h))
                for col, x in zip((n, bands, sketches), last[key], strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), _lists(bands), _lists(sketches)], ["doc_id", "key", "n", "bands", "sketch"])

    return docs.select("doc_id", "key", "text").mapInArrow(sign, SIGNATURE)


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches leave the threshold open."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.where(_sizes() & _close()).select("a", "b")


def _sizes():
    num, den = THRESHOLD
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("na") > 0)


def _close():
    bits = reduce(lambda x, y: x + y, (F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(LANES)))
    return bits <= screen(F.col("na").cast("double"), F.col("nb").cast("double"), F.exp, F.sqrt)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of the threshold at least, on full sets (rep, hashes).

    A row of a pivot's set stands before up to STAR rows of its partners' sets; the stream is
    sorted, so a task holds one pivot and one partner at a time.
    """
    num, den = THRESHOLD
    pairs = pairs.withColumn("star", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("deg") / STAR))).cast("long")).drop("deg")
    partner = pairs.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "star", "b", F.lit(1).alias("kind"), "hashes")
    pivot = pairs.select("a", "star").distinct().join(sets.withColumnRenamed("rep", "a"), "a").select("a", "star", F.col("a").alias("b"), F.lit(0).alias("kind"), "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            left, right = [], []
            a, star, b, kind = (batch.column(i).to_pylist() for i in range(4))
            at_, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for i in range(batch.num_rows):
                mine = flat[at_[i] : at_[i + 1]]
                if (a[i], star[i]) != at:
                    at, pivots = (a[i], star[i]), []
                if kind[i] == 0:
                    pivots.append(mine.copy())
                    continue
                for p in pivots:
                    both = len(np.intersect1d(p, mine, assume_unique=True))
                    if den * both >= num * (len(p) + len(mine) - both) and both:
                        left.append(a[i])
                        right.append(b[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    stream = pivot.unionByName(partner).repartition("a", "star").sortWithinPartitions("a", "star", "kind")
    return stream.mapInArrow(compare, "a long, b long")


def _with_degree(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    pairs = scratch.table(pairs, name)
    deg = scratch.table(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), f"{name}-deg")
    return pairs.join(deg, "a")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) of every id in links (a, b): the smallest id reachable. Nothing is collected.

    Each node hooks to its smallest neighbour; pointer jumping flattens the trees; the links are
    rewritten to roots and the rest contracted again.
    """
    edges = scratch.table(links.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    maps, k = [], 0
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.least("a", "b").alias("p")).unionByName(edges.select(F.col("b").alias("id"), F.least("a", "b").alias("p")))
        parent = scratch.table(ends.groupBy("id").agg(F.min("p").alias("p")), f"{name}-p{k}")
        jump = 0
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("up"))
            nxt = scratch.table(parent.join(up, "p").select("id", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")), f"{name}-p{k}j{jump}")
            moved = not nxt.where("moved").isEmpty()
            parent, jump = nxt.select("id", "p"), jump + 1
            if not moved:
                break
        maps.append(parent)
        a = edges.join(parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
        both = a.join(parent.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        k += 1
        edges = scratch.table(both.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-e{k}")
    if not maps:
        return scratch.table(edges.select(F.col("a").alias("id"), F.col("b").alias("comp")), f"{name}-out")
    out = maps[0].select("id", F.col("p").alias("comp"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("id").alias("comp"), F.col("p").alias("up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return scratch.table(out, f"{name}-out")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = texts(docs).withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary")).withColumn("key", F.unhex(F.sha2("text", 256)))
    signed = scratch.table(signatures(docs), "signed")
    # a class's smallest id, with its signature; at most one row a class and task is shuffled
    first = signed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("m"))
    sig = scratch.table(first.select("key", F.col("m.doc_id").alias("rep"), "m.n", "m.bands", "m.sketch"), "classes")
    rows = scratch.table(signed.select("doc_id", "key", "n"), "rows")
    scratch.drop("signed")  # the signatures of classes are written, and rows need none
    sketches = sig.select("rep", "n", "sketch")
    buckets = sig.select("rep", F.explode("bands").alias("key"))
    shared = scratch.table(buckets.groupBy("key").agg(F.min("rep").alias("p"), F.max("rep").alias("last")).where("last > p").drop("last"), "shared")
    members = scratch.table(buckets.join(shared, "key").select("key", "rep", "p"), "members")
    scratch.drop("shared")
    star = _screened(members.where("rep <> p").select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct(), sketches)

    sets = _sets(docs, sig.select("rep", F.col("key").alias("text_key")), members.select("rep").distinct(), scratch)
    links = [scratch.table(confirmed(_with_degree(star, scratch, "star0"), sets), "links0")]
    comp = components(links[0], scratch, "c0")
    tried = [scratch.read(star.schema, "star0")]
    for k in range(1, PIVOT_ROUNDS + 2):
        placed = members.select("key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
        placed = scratch.table(placed, f"placed{k}")
        sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep")).alias("one"))
        mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp", F.col("one.rep").alias("pivot"))).alias("main")).where("comps > 1")
        mixed = scratch.table(mixed.select("key", F.col("main.comp").alias("main"), F.col("main.pivot").alias("pivot")), f"mixed{k}")
        if mixed.isEmpty():
            break
        open_ = placed.join(mixed, "key")
        if k <= PIVOT_ROUNDS:
            cand = _screened(open_.where("comp <> main").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), sketches)
            for old in tried:
                cand = cand.join(old.select("a", "b"), ["a", "b"], "left_anti")
            deg = _with_degree(cand, scratch, f"star{k}")
            tried.append(scratch.read(star.schema, f"star{k}"))
            links.append(scratch.table(confirmed(deg, sets), f"links{k}"))
        else:
            links.append(scratch.table(_across(scratch.table(open_, f"open{k}"), sketches, sets), f"links{k}"))
        scratch.drop(f"placed{k}", f"mixed{k}", f"open{k}")
        if links[-1].isEmpty():
            continue
        comp = components(reduce(DataFrame.unionByName, links), scratch, f"c{k}")
    found = scratch.table(sig.select("key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp")), "found")
    out = rows.join(found, "key", "left")
    scratch.keep("rows", "found")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, hashes) of the classes that share a bucket with another."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py(), seen) for t in batch.column(1)])], ["rep", "hashes"])

    wanted = scratch.table(classes.join(wanted, "rep").select("rep", "text_key"), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    chosen = docs.join(ids, (docs["doc_id"] == ids["rep"]) & (docs["key"] == ids["text_key"])).select("rep", "text")
    sets = scratch.table(chosen.mapInArrow(hashes, "rep long, hashes array<long>"), "sets")
    scratch.drop("wanted")
    return sets


def _across(open_: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs of a bucket across components, one of them not in the main one.

    Sets travel with the bucket's rows, and are compared only where sizes and sketches leave a pair open.
    """
    full = open_.join(sketches, "rep").join(sets, "rep")
    side = lambda s: [F.col("rep").alias(s), F.col("comp").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("hashes").alias(f"h{s}")]
    minor = full.where("comp <> main").select("key", *side("a"))
    other = full.select("key", F.col("main").alias("mb"), *side("b"))
    num, den = THRESHOLD
    once = (F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b"))
    linked = F.size(F.array_intersect("ha", "hb")) * (den + num) >= (F.col("na") + F.col("nb")) * num
    return minor.join(other, (minor["key"] == other["key"]) & (F.col("ca") != F.col("cb")) & once & _sizes() & _close() & linked).select("a", "b").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but one of each component: that of the smallest doc_id.

    Rows are judged, not ids: repeated rows are copies of each other, rows that share a doc_id but not
    a text are documents of their own, and rows with a null id take part (they stay only if no row of
    their component has an id). Of several rows with that id the one that stands first stays.
    """
    scratch = Scratch(docs.sparkSession, "neardup-clean")
    docs, row = numbered(docs, scratch)
    found = near_duplicates(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    found = scratch.table(docs.select(row, F.col("doc_id").cast("long").alias("doc_id")).join(found, row), "found")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    best = scratch.table(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("m")).where("n > 1").select("component_id", F.col("m.row").alias("stays")), "best")
    return without(docs, found.join(best, "component_id").where(F.col(row) != F.col("stays")).select(row), row).drop(row)
