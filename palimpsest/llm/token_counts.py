"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where it is proven safe.

A text over ``chunk_chars`` is encoded in chunks that overlap. Two neighbours are spliced at a
position p inside their overlap where both have a token that starts there, the character before p is
a letter or digit and the one at p is a space, a tab or a line end. The byte-level pre-tokenizer always
splits there: no token of it holds a letter or digit followed by white space, and matching goes on
from p without looking back. So what stands left of p is encoded as in the whole text by the left
chunk, and what stands right of p by the right one. Where an overlap has no such position (one
endless word), the left chunk is widened, twice as far each time, in the end to the whole text. A
stretch of n characters without such a position is encoded over and over, but with widths that
double, so a few times n characters in all, never n^2. Memory is that of the text and of the offsets
of the widest chunk, which is as long as the longest such stretch.

A text of at most ``chunk_chars`` is one chunk and needs no splice.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a row per input row, repeated
or null ids included.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

CHUNK_CHARS = 1 << 13
OVERLAP_CHARS = 1 << 7
LIMIT = 512


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json file, once for each worker; without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_chunk(tok, text: str, lo: int, hi: int):
    """The encoding of text[lo:hi], with offsets; they stay in the library and are asked for by position."""
    return tok.encode(text[lo:hi], add_special_tokens=False)


def _starting_at(enc, at: int) -> int | None:
    """The number of the token that starts at character ``at`` of a chunk."""
    k = enc.char_to_token(at)
    return k if k is not None and enc.token_to_chars(k)[0] == at else None


def _splice(text: str, lo: int, hi: int, left, left_lo: int, right, right_lo: int) -> tuple[int, int, int] | None:
    """The last proven common boundary in (lo, hi), and the numbers of the tokens there in both chunks."""
    for p in range(hi - 1, lo, -1):
        if text[p] in " \n\t\r" and text[p - 1].isalnum():
            k, m = _starting_at(left, p - left_lo), _starting_at(right, p - right_lo)
            if k is not None and m is not None:
                return p, k, m
    return None


def count_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of text, from chunks of it."""
    size, lo, start, first, total = len(text), 0, 0, 0, 0
    hi = min(chunk, size)
    left = encode_chunk(tok, text, lo, hi)
    while hi < size:
        wide = overlap
        while True:
            nlo, nhi = max(lo, hi - wide), min(size, hi + chunk)
            right = encode_chunk(tok, text, nlo, nhi)
            at = _splice(text, max(nlo, start), hi, left, lo, right, nlo)
            if at is not None:
                total += at[1] - first
                start, first, left, lo, hi = at[0], at[2], right, nlo, nhi
                break
            if nlo <= max(lo, start) or wide >= hi - lo:  # the overlap can't grow leftwards: the left chunk takes in more
                hi = min(size, hi + max(chunk, hi - lo))
                left = encode_chunk(tok, text, lo, hi)
                if hi == size:
                    break
            wide *= 2
    return total + len(left) - first


def count_batch(tok, batch: list[str | None], chunk: int, overlap: int) -> list[int]:
    out = [0] * len(batch)
    short = [i for i, t in enumerate(batch) if t and len(t) <= chunk]
    for at in range(0, len(short), 256):
        part = short[at : at + 256]
        for i, enc in zip(part, tok.encode_batch_fast([batch[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = len(enc)
    for i, t in enumerate(batch):
        if t and len(t) > chunk:
            out[i] = count_long(tok, t, chunk, overlap)
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; one pass, no shuffle."""

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load(tokenizer_path)
        for part in parts:
            yield pd.Series(count_batch(tok, part.tolist(), chunk_chars, overlap_chars), dtype="int64")

    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    out = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
