"""Token counts of byte-level BPE: known whole tokens are counted, only the rest is merged."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from forumlake.llm.common import Cache, ship_package

# Letters of the texts that are cut here; any other text goes to the library whole. In this
# range the character classes of Python and of the library agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
CUT_HERE = re.compile(rf"[\t\n\r\x20-\x7e¡¿«»×÷{LETTERS}]*")

# Fixed value: the pre-token pattern of this kind of tokenizer.
PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTER_OF = byte_letters()


def in_letters(text: str) -> str:
    return "".join([LETTER_OF[b] for b in text.encode()])


def whole_tokens(path: str) -> list[str]:
    """The strings that are proven to encode alone as one token.

    Each entry of the vocabulary is written as text, if its bytes are text, must be one
    pre-token, and is merged by the model itself; it counts if one token remains.
    """
    tokenizer = load(path)
    byte_of = {c: b for b, c in enumerate(LETTER_OF)}
    proven = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(byte_of[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if PRE_TOKEN.fullmatch(text) and len(tokenizer.model.tokenize(entry)) == 1:
            proven.append(text)
    return proven


@functools.lru_cache(maxsize=4)
def counter(path: str, known: tuple):
    """text -> number of tokens, with the proven whole tokens at hand."""
    tokenizer = load(path)
    merged = Cache(lambda pre: len(tokenizer.model.tokenize(in_letters(pre))),
                   dict.fromkeys(known, 1))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if not CUT_HERE.fullmatch(text) or any(s in text for s in special):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(merged.__getitem__, PRE_TOKEN.findall(text)))

    return count


def with_token_counts(
    df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens.

    The tokenizer file must be at ``tokenizer_path`` on every executor. Null counts as
    empty, which has 0 bytes and 0 tokens. Each row is counted on its own, with its whole
    text; a text with a special string, or with letters outside the Latin ranges, is
    encoded by the library. Columns other than the two named are not read.
    """
    ship_package(df.sparkSession)
    context = df.sparkSession.sparkContext
    known = context.broadcast(tuple(whole_tokens(tokenizer_path)))

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer_path, known.value)
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = df.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
