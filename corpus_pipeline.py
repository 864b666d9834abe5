"""A corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before kept, written as Parquet and read again. Rows are judged,
not ids: a row with a null or repeated doc_id is kept or dropped for its own text. An empty table
passes through every stage; the last then returns no rows. Columns beside doc_id, text, lang and source
are carried through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, language_id, near_dup, packing, toxicity
from palimpsest.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under a half. Null and empty texts score the curve's bias and stay; long texts are read whole."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language, with lang as what is declared and source as the host.

    Null, empty and letterless texts have no words and go, as does text that fits no language; of
    equally likely languages the first by name is taken; repeated rows are judged one by one.
    """
    return language_id.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of its smallest doc_id, of equal ones the first.

    Repeated rows are copies, so one stays; rows of one id and different texts are documents of their
    own; a row without an id stays only if no row of its group has one. Wordless rows link with nothing.
    """
    return near_dup.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't cover half of a benchmark item in tiles of five words. Null, empty and short texts cover none; long ones are read whole."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of at most 2048 tokens, with its sequence and place. A null or empty text is one piece, repeated rows are packed once each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages need trained models, exact near-duplicate search and a tokenizer: no SQL states them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
