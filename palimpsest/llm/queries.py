"""The operators applied to the standard tables, whole, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, scratch)
    records = warc.resolve_revisits(warc.read_archives(spark, path), scratch)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload_ok")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, of_documents

    return identify(of_documents(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op8 on web pages, which declare a language in their markup and have addresses."""
    from .language_id import identify, of_pages

    return identify(of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("query_row")


def op10_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits, op2_license_scan, op3_token_counts, op4_url_filter, op5_benchmark_decontamination, op6_toxicity_grammar,
        op7_best_fit_packing, op8_language_id, op9_exact_topk, op10_minhash_odd_sketch, page_language_id,
    )
}
