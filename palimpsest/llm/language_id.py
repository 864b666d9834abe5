"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

posterior(l) ~ P(text | l)^tempered * P(declared | l) * P(l | host)

- Text: character trigrams of each word, multinomial, trained on a bounded sample of rows of every
  declared language, however few declare it. Words of a text are not independent, so the mean log likelihood of a word
  counts as often as the square root of the number of words, ``TEXT_WORDS`` times at most.
- Declared language (a markup's or a column's): how often each value goes with each language, over
  all rows, smoothed.
- Host: P(l | host) is shrunk to P(l | domain), that to P(l | address suffix), that to P(l); each
  level weighs as much as ``PRIOR`` rows of its parent. A new host gets its suffix's prior.

The tables of the last two are grouped aggregates over all rows, of what the text alone says. A row's
own vote is taken out of every count before it is used on that row, so its text counts once, however
small its host. A table of hosts is joined, never collected, and a hot host is split by Spark since
both sides are plain scans.

``UNKNOWN`` is a language like the others for text of none of them: each trigram has the same
likelihood, between those of the languages' own texts and of texts read as the next best language.
It takes its part of the posterior but is never named, unless nothing is declared in the whole table.

A row is accepted if its text has words and the posterior of its best known language reaches ``ACCEPT``.

Defined results: of languages that are equally likely the first by name is taken; long texts are read
whole, and no more than ``TEXT_WORDS`` words of theirs count; a null, empty or letterless text has no words: its language is that of the other
evidence, and it isn't accepted; null declared values, suffixes and hosts are values like others,
shared by all rows that lack them; rows with null or repeated ids are judged one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, digest, without

TRAIN_ROWS = 20_000
#: Rows of each language at least, where it has so many, and trigrams of the model for each.
LANGUAGE_ROWS, LANGUAGE_TRIGRAMS = 200, 500
TRIGRAMS = 20_000
#: The name of no modelled language; as a declared tag it says the same.
UNKNOWN = "und"
TEXT_WORDS = 12
PRIOR = 20.0
ACCEPT = 0.5
_WORD = re.compile(r"[^\W\d_]+")

#: What the operator reads: any id, the text, and evidence beside it (null where there is none).
EVIDENCE = ("id", "text", "declared", "suffix", "domain", "host")


def of_documents(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as evidence: the lang column is what is declared, a source stands for a host; and more columns."""
    none = F.lit(None).cast("string")
    return docs.select(
        *more, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), _tag(F.col("lang")).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host")
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as evidence: text without markup, the html element's lang, and the address's parts."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    parts = F.split(host, r"\.")
    domain = F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(host)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<[^>]*>|&[a-z#0-9]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"), text.alias("text"), _tag(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)).alias("declared"), F.nullif(F.element_at(parts, -1), F.lit("")).alias("suffix"), F.nullif(domain, F.lit("")).alias("domain"), F.nullif(host, F.lit("")).alias("host")
    )


def _tag(x: Column) -> Column:
    """The primary part of a language tag, lower case; null if empty."""
    return F.nullif(F.lower(F.substring_index(x.cast("string"), "-", 1)), F.lit(""))


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)] if len(padded) > 2 else [padded]


class _WordRows(dict):
    """Row numbers of words in a matrix of log likelihoods, filled as words are met."""

    def __init__(self, model: TextModel):
        super().__init__()
        self.model, self.rows = model, np.empty((model.word_rows, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.rows):  # one text has more new words than rows: it is finished in a larger matrix
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        get, unseen = self.model.number.get, len(self.model.logs) - 1
        self.rows[at] = self.model.logs[[get(t, unseen) for t in trigrams(word)]].sum(axis=0)
        return at


#: Numbers in a worker's matrix of words; between texts it is started anew beyond half.
WORD_CELLS = 1 << 20


class TextModel:
    """Log likelihoods of words: the sum over their trigrams; kept for the words seen before.

    logs: a row for each known trigram, the last for all others. number: a trigram's row.
    """

    def __init__(self, languages: list[str], known: list[str], logs: np.ndarray):
        self.languages, self.number, self.logs = languages, {t: i for i, t in enumerate(known)}, logs
        self.word_rows = max(1 << 10, WORD_CELLS // len(languages))

    def start(self) -> None:
        self.seen = _WordRows(self)

    def likelihood(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words and the tempered log likelihood for each language."""
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return 0, np.zeros(len(self.languages))
        if len(self.seen) > self.word_rows // 2:
            self.start()
        at = np.array([self.seen[w] for w in words])
        return len(words), np.ones(len(at)) @ self.seen.rows.take(at, axis=0) / len(at) * min(TEXT_WORDS, len(words) ** 0.5)


def train(rows: DataFrame, scratch: Scratch, languages: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> TextModel:
    """From a sample, by a hash of id and text, of about train_rows rows that declare a language.

    Without a list, the languages are all that are declared. Each gives its share of the rows, but as
    many as an equal part and ``LANGUAGE_ROWS`` where it has them. The last language is ``UNKNOWN``.
    """
    declared = rows.where("declared is not null and text is not null")
    per = {r["declared"]: r["count"] for r in declared.groupBy("declared").count().collect()}
    languages = sorted(set(languages or per) - {UNKNOWN})
    if not languages:
        return TextModel([UNKNOWN], [], np.zeros((1, 1)))
    least = max(LANGUAGE_ROWS, train_rows / len(languages))
    shares = [(x, min(1.0, max(train_rows / sum(per.values()), least / per[x]))) for x in languages if x in per]
    part = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    shares = F.broadcast(rows.sparkSession.createDataFrame(shares, "declared string, share double"))
    sample = declared.join(shares, "declared").where(part < F.col("share")).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = seen.setdefault(lang, Counter())
                for w, n in Counter(_WORD.findall(text.as_py().lower())).items():
                    for t in trigrams(w):
                        c[t] += n
        flat = [(lang, t, n) for lang, c in seen.items() for t, n in c.items()]
        cols = list(zip(*flat, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "t", "n"])

    counts = scratch.table(sample.mapInArrow(count, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")), "trigrams")
    of_language = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    size = max(TRIGRAMS, LANGUAGE_TRIGRAMS * len(languages))
    # by their share in a language, so that those of rare languages count as much
    top = counts.join(F.broadcast(of_language), "lang").groupBy("t").agg(F.max(F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("share"), "t").limit(size)  # the model's size
    known = counts.join(top.select("t"), "t").toPandas()
    trigram_names = sorted(set(known["t"]))
    row, column = {t: i for i, t in enumerate(trigram_names)}, {x: i for i, x in enumerate(languages)}
    n = np.zeros((len(row), len(languages)))
    n[known["t"].map(row).to_numpy(int), known["lang"].map(column).to_numpy(int)] = known["n"].to_numpy(float)
    totals = n.sum(0) + 0.5 * (len(n) + 1)
    logs = np.vstack([np.log((n + 0.5) / totals), np.log(0.5 / totals)])
    return TextModel([*languages, UNKNOWN], trigram_names, np.hstack([logs, np.full((len(logs), 1), _unknown(n, logs))]))


def _unknown(n: np.ndarray, logs: np.ndarray) -> float:
    """A trigram's log likelihood in no language: halfway from the worst language's mean over its own
    text to the mean over texts read as their next best language, or as equally likely trigrams."""
    n = n[:, n.sum(0) > 0]
    if not n.size:
        return -float(np.log(len(logs)))
    cross = (n / n.sum(0)).T @ logs[:-1]  # text's language, reader's
    own, uniform = cross.max(1).min(), -np.log(len(logs))
    others = np.sort(cross, 1)[:, -2] if cross.shape[1] > 1 else np.array([uniform])
    return float((own + np.minimum(others, own).mean()) / 2)


def identify(rows: DataFrame, languages: list[str] | None = None, train_rows: int = TRAIN_ROWS, key: str = "id") -> DataFrame:
    """id, declared, text_language, language, posterior, n_words, accepted for every row of evidence.

    ``key`` names the column that comes out as id.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "langid")
    rows = rows.select(F.col(key).alias("key"), *EVIDENCE)
    model = train(rows, scratch, languages, train_rows)
    names, k = model.languages, len(model.languages)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.start()
        for batch in batches:
            got = [model.likelihood(t.as_py()) for t in batch.column(1)]
            ll = pa.array([x.tolist() for _, x in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([n for n, _ in got], pa.int64()), ll], ["id", "declared", "suffix", "domain", "host", "n_words", "ll"])

    kind = rows.schema["key"].dataType.simpleString().replace("bigint", "long")
    judged = scratch.table(rows.drop("id").select("key", *EVIDENCE[1:]).mapInArrow(judge, f"id {kind}, declared string, suffix string, domain string, host string, n_words long, ll array<double>"), "judged")
    for c in ("declared", "suffix", "domain", "host"):  # a join key must not be null
        judged = judged.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    best = F.when(F.col("n_words") > 0, F.expr("cast(array_position(ll, array_max(ll)) - 1 as int)"))
    judged = judged.withColumn("l", best)
    votes = judged.where("l is not null")
    each = [F.sum(F.when(F.col("l") == i, 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(k)]
    sums, counts = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)], F.array(*(F.col(f"c{i}") for i in range(k)))
    hosts = scratch.table(votes.groupBy("host", "domain", "suffix").agg(*each), "host-counts")
    overall = [x or 0.0 for x in hosts.agg(*sums).first()]
    by_suffix = scratch.table(hosts.groupBy("suffix").agg(*sums).select("suffix", counts.alias("suffix_n")), "suffixes")
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).select("domain", "suffix", counts.alias("domain_n"))
    priors = scratch.table(hosts.select("host", "domain", "suffix", counts.alias("host_n")).join(by_domain, ["domain", "suffix"]), "hosts")
    declared = scratch.table(votes.groupBy("declared").agg(*each).select("declared", counts.alias("declared_n")), "declared")
    values = declared.count() + 1
    out = judged.join(priors, ["host", "domain", "suffix"], "left").join(by_suffix, "suffix", "left").join(declared, "declared", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    voted = F.col("l").isNotNull().cast("double")

    def others(c: Column) -> Column:
        """Counts without the row's own vote."""
        return F.transform(F.coalesce(c, zero), lambda x, i: x - F.when(i == F.col("l"), 1.0).otherwise(0.0))

    def shrunk(c: Column, parent: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(c, parent, lambda x, q: (x + F.lit(PRIOR) * q) / (total + PRIOR))

    all_n = F.array(*map(F.lit, overall))
    out = out.withColumn("all_n", others(all_n)).withColumn("p", F.transform("all_n", lambda x: (x + 1.0) / (F.lit(sum(overall) + k) - voted)))
    # a row of a new host has no vote: nothing is taken out of zeros
    for level in ("suffix_n", "domain_n", "host_n"):
        out = out.withColumn("p", F.when(F.col(level).isNull(), F.col("p")).otherwise(shrunk(others(F.col(level)), F.col("p"))))
    said = F.zip_with(others(F.col("declared_n")), F.col("all_n"), lambda c, n: F.log((c + 1.0) / (n + F.lit(float(values)))))
    said = F.when((F.col("declared") != "") & F.col("declared_n").isNotNull(), said).otherwise(zero)
    scores = F.zip_with(F.zip_with("ll", said, lambda a, b: a + b), F.col("p"), lambda a, p: a + F.log(p))
    out = out.select("id", "declared", "n_words", "ll", scores.alias("z"))
    known = lambda c: F.slice(c, 1, max(1, k - 1))
    z = F.array_max("z")
    norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(F.col("z"))))
    tags = F.array(*map(F.lit, names))
    pick = lambda c: F.element_at(tags, F.array_position(c, F.array_max(known(c))).cast("int"))
    out = out.select(
        "id", F.nullif("declared", F.lit("")).alias("declared"), F.when(F.col("n_words") > 0, pick(F.col("ll"))).alias("text_language"), pick(F.col("z")).alias("language"), (F.exp(F.array_max(known(F.col("z"))) - z) / norm).alias("posterior"), "n_words"
    )
    return out.withColumn("accepted", (F.col("n_words") > 0) & (F.col("posterior") >= ACCEPT))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are accepted. Rows are judged, not ids: a null or repeated id is none the worse.

    Rows of equal evidence are judged alike, so a digest of the evidence stands for them.
    """
    scratch = Scratch(docs.sparkSession, "langid-clean")
    mark = "_evidence"
    while mark in docs.columns:
        mark += "_"
    docs = docs.withColumn(mark, digest(F.col("text").cast("string"), _tag(F.col("lang")), F.col("source").cast("string")))
    rejected = identify(of_documents(docs, mark), key=mark).where(~F.col("accepted")).select("id").distinct()
    return without(docs, scratch.table(rejected, "rejected"), mark).drop(mark)
