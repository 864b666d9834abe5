"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech, clause end) and a
weight. Transducers rewrite a clause's symbols: each reads what the one before wrote, adds a tag to
insults and threats and a weight to the path, and ends its scopes with the clause. One cascade reads
from left to right (standing alone, negation, reported speech, target), a second one reads its output
from right to left (the same, for what follows the word, and the label of the pattern), so attribution
and negation count on both sides. Each cascade is composed once into a deterministic table. Weights
add up along a word's path (its own and that of its arcs), and the best path of each pattern, if over 0,
is the clause's score: long clauses of weak words stay weak.

Clauses are scored, not words: a word without company in its clause matches nothing, nor does a threat
without a target. A document's features are the best and the summed clause scores of each pattern; a
logistic curve over them gives the score.

Insults and their weights are learned: log odds of the document frequency of words and word
beginnings in toxic and in clean labelled rows. The rest of the lexicon is fixed. Training takes at
most ``train_toxic`` and ``train_clean`` labelled rows, chosen by a hash of the id among the rows that
``trainable`` admits; nothing but the text is an input of a score.

Defined results: a null or empty text has no pattern and gets the score of the curve's bias; without
labelled rows of both kinds every score is 0; repeated or null ids give a row each; long texts are
read whole, in time in proportion to their length; of several labels of an id the toxic one counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

TRAIN_TOXIC = 10_000
TRAIN_CLEAN = 20_000
LEXICON = 4_000
MIN_DOCS = 4
MIN_LOG_ODDS = 2.5
STEMS = (4, 5, 6)
SCOPE = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
PATTERNS = ("plain", "negated", "reported", "targeted", "threat")

# Closed-class words of English, German, French and Spanish.
FIXED_WORDS = {
    THREAT: "kill hurt destroy burn shoot stab beat töten schlagen tuer frapper matar golpear",
    TARGET: "you your he she they them his her du dich dein ihr euch tu toi ton vous il elle usted ellos ellas",
    NEGATION: "not never no nobody nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says told wrote claimed reported sagte sagt schrieb dit écrit dijo dice escribió",
}
_FIXED = {w: c for c, ws in FIXED_WORDS.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")


#: Symbols: a letter for the class (by code), then the tags that machines added to it.
CLASSES = "OIHTNRE"
_HOT_CLASSES = "IH"
#: Weights of the arcs that tag a word, added along the path.
ARC = {"n": -3.0, "r": -2.0, "t": 1.0}
THREAT_ARC = 2.0

State = int | tuple
Step = Callable[[State, str], tuple[State, str, float]]


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: step(state, symbol) -> (state, symbol written, arc's weight)."""

    step: Step
    start: State = 0

    def compose(self, other: Transducer) -> Transducer:
        """other reads what this one writes; weights add up."""

        def step(state: State, x: str) -> tuple[State, str, float]:
            a, y, w = self.step(state[0], x)
            b, z, v = other.step(state[1], y)
            return (a, b), z, w + v

        return Transducer(step, (self.start, other.start))

    def table(self, alphabet: list[str]) -> tuple[list[dict[str, tuple[int, str, float]]], list[str]]:
        """Rows of the reachable states, and all symbols written."""
        number, rows, todo, out = {self.start: 0}, [], [self.start], set()
        for state in todo:
            row = {}
            for x in alphabet:
                nxt, y, w = self.step(state, x)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row[x] = (number[nxt], y, w)
                out.add(y)
            rows.append(row)
        return rows, sorted(out)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, with its weight."""
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append((y, w))
        return out


def _tagged(x: str, tag: str) -> tuple[str, float]:
    """A tag counts once, whichever side it comes from."""
    return (x, 0.0) if tag in x[1:] else (x + tag, ARC.get(tag, 0.0))


def scope(opener: str, length: int | None, tag: str) -> Transducer:
    """Tags insults and threats after an opener: for so many words, or to the clause's end."""

    def step(left: int, x: str) -> tuple[int, str, float]:
        y, w = _tagged(x, tag) if left and x[0] in _HOT_CLASSES else (x, 0.0)
        nxt = 0 if x[0] == "E" else (length or 1) if x[0] == opener else left if length is None else max(0, left - 1)
        return nxt, y, w

    return Transducer(step)


def company(tag: str) -> Transducer:
    """Tags insults and threats that no word of the clause stands before."""

    def step(seen: int, x: str) -> tuple[int, str, float]:
        y, w = _tagged(x, tag) if not seen and x[0] in _HOT_CLASSES else (x, 0.0)
        return int(x[0] != "E"), y, w

    return Transducer(step)


def judge() -> Transducer:
    """Writes the pattern that a tagged word stands for; the empty symbol for none."""

    def step(state: int, x: str) -> tuple[int, str, float]:
        kind, tags = x[0], x[1:]
        if kind not in _HOT_CLASSES or {"a", "z"} <= set(tags) or (kind == "H" and "t" not in tags):
            return 0, "", 0.0
        name = "negated" if "n" in tags else "reported" if "r" in tags else "threat" if kind == "H" else "targeted" if "t" in tags else "plain"
        return 0, name, THREAT_ARC if kind == "H" else 0.0

    return Transducer(step)


FORWARD = [company("a"), scope("N", SCOPE, "n"), scope("R", None, "r"), scope("T", SCOPE, "t")]
BACKWARD = [company("z"), scope("N", SCOPE, "n"), scope("R", None, "r"), scope("T", SCOPE, "t"), judge()]
_FORWARD, _SYMBOLS = reduce(Transducer.compose, FORWARD).table(list(CLASSES))
_BACKWARD, _ = reduce(Transducer.compose, BACKWARD).table(_SYMBOLS)


@dataclass
class Lexicon(dict):
    """Class code of a word, kept for words seen before. units: weight of whole words and of beginnings ('abcd*')."""

    units: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)

    __hash__ = None

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        w = max((self.units.get(u, 0.0) for u in units_of(word)), default=0.0)
        if w:
            code, self.weight[word] = INSULT, w
        elif not word[0].isalpha():
            code = END
        else:
            code = _FIXED.get(word, OTHER)
        self[word] = code
        return code


def units_of(word: str) -> list[str]:
    """A word as the lexicon can know it."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


_HOT = re.compile(b"[%c%c]" % (INSULT, THREAT))
THREAT_WEIGHT = 1.0
N_FEATURES = 2 * len(PATTERNS) + 1


def clause_scores(text: str | None, lexicon: Lexicon) -> list[tuple[str, list[float]]]:
    """(clause, score of each pattern) of the clauses in which a pattern matches."""
    if not text:
        return []
    words = _TOKEN.findall(text.lower())
    codes = bytes([lexicon[w] for w in words])
    out, done = [], 0
    for m in _HOT.finditer(codes):
        if m.start() < done:
            continue
        start = codes.rfind(END, 0, m.start()) + 1
        done = codes.find(END, m.start())
        done = len(codes) if done < 0 else done
        best = [0.0] * len(PATTERNS)
        for i, (name, weight) in enumerate(read_clause([CLASSES[c] for c in codes[start:done]])):
            if name:
                k = PATTERNS.index(name)
                best[k] = max(best[k], lexicon.weight.get(words[start + i], THREAT_WEIGHT) + weight)
        if any(best):
            out.append((" ".join(words[start:done]), best))
    return out


def read_clause(symbols: list[str]) -> list[tuple[str, float]]:
    """Pattern ('' for none) and weight of the path's arcs for each word, by the two composed tables."""
    state, middle = 0, []
    for x in symbols:
        state, y, w = _FORWARD[state][x]
        middle.append((y, w))
    state, out = 0, []
    for x, w in reversed(middle):
        state, y, v = _BACKWARD[state][x]
        out.append((y, w + v))
    return out[::-1]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Best and damped total clause score for each pattern, and a damped number of matched clauses."""
    got = clause_scores(text, lexicon)
    best = [max((s[k] for _, s in got), default=0.0) for k in range(len(PATTERNS))]
    total = [math.log1p(sum(s[k] for _, s in got)) for k in range(len(PATTERNS))]
    return [*best, *total, math.log1p(len(got))]


@dataclass
class Model:
    units: dict[str, float]
    bias: float
    coef: list[float]

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        z = self.bias + sum(c * x for c, x in zip(self.coef, features(text, lexicon), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, train_toxic / max(1, counts.get(1, 0)))).otherwise(min(1.0, train_clean / max(1, counts.get(0, 0))))
    chosen = known.where(part < share)
    # bounded by the two parameters (and chance), so it may be broadcast
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> Model | None:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(training_rows(docs, labels, train_toxic, train_clean), "train")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _TOKEN.findall((text.as_py() or "").lower()) if w[0].isalpha()}
                seen[toxic].update({u for w in words for u in units_of(w)})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[toxic])), pa.array(list(seen[toxic].values()), pa.int64()), pa.array([toxic] * len(seen[toxic]), pa.int32())], ["unit", "n", "toxic"])

    counts = rows.mapInArrow(count, "unit string, n long, toxic int").groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    strong = counts.where(F.col("t") >= MIN_DOCS).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    # the lexicon's size is a property of the model: its strongest units by documents explained
    units = {r["unit"]: float(r["w"]) for r in strong.orderBy(F.desc(F.col("t") * F.col("w")), "unit").limit(LEXICON).collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(units=units)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py(), lexicon) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = rows.mapInArrow(measure, "x array<double>, toxic int").toPandas()  # N_FEATURES numbers for each row of the bounded sample
    bias, coef = logistic(np.array(got["x"].tolist()), got["toxic"].to_numpy(float))
    scratch.drop("train")
    return Model(units, bias, coef)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Ridge logistic regression by damped Newton steps; rows are ordered first, so the result doesn't depend on their order."""
    order = np.lexsort((y, *x.T))
    x, y = np.c_[np.ones(len(x)), x][order], y[order]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), [float(v) for v in w[1:]]


def scorer(docs: DataFrame, model: Model | None):
    """A column function text -> score."""
    if model is None:
        return lambda text: F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        lexicon = Lexicon(units=model.units)
        for part in parts:
            yield pd.Series([model.score(t, lexicon) for t in part.tolist()], dtype=float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; one pass over the texts after training."""
    score = scorer(docs, learn(docs, labels))
    out = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under limit."""
    score = scorer(docs, learn(docs, labels))
    return docs.where(score(docs["text"].cast("string")) < limit)


