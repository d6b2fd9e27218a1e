"""Packing by minimum bin slack: each bin takes the fullest combination of lengths left."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forumlake.llm.common import Cache, ship_package
from forumlake.llm.tokens import in_letters, load
from forumlake.session import durable

CAPACITY = 4096
END_ID = 1

# Texts of these characters are cut into words here, others by the library. In this range
# normal form, lower case and character classes of Python and of the library agree.
LETTERS = "a-zß-öø-įı-ňŊ-ſ"
CUT_HERE = re.compile(r"[\t\n\r\x20-\x7e¡¿«»×÷À-įı-ňŊ-ſ]*")

# Fixed value: the word pattern of this kind of tokenizer.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """text -> its ids as little-endian 32-bit bytes.

    White space always parts words here, so a text is split at it and each distinct chunk
    is cut into words and encoded once.
    """
    tokenizer = load(path)

    def word_ids(word: str) -> bytes:
        tokens = tokenizer.model.tokenize(in_letters(word))
        return array("I", [t.id for t in tokens]).tobytes()

    words = Cache(word_ids)
    chunks = Cache(lambda chunk: b"".join([words[w] for w in WORD.findall(chunk)]), most=400_000)

    def encode(text: str) -> bytes:
        if "<|" in text or not CUT_HERE.fullmatch(text):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(chunks.__getitem__, text.lower().split()))

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each document ending in id 1."""
    ship_package(df.sparkSession)
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                doc = None if pd.isna(doc) else int(doc)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            names = [c.split()[0] for c in PIECES.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64", **dict.fromkeys(names[1:], "int64"), "piece": "int32"})

    read = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInPandas(cut, PIECES)


class Slot(NamedTuple):
    """Pieces of one length, by rank from ``first`` on, go ``each`` at a time into sequences
    from ``sequence`` on, at ``offset`` and behind each other."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often, of the available, with the largest sum that ``room`` takes.

    The sums that can be reached are bits of one integer. Copies of a length are added in
    lots of 1, 2, 4 … that together make any number of them; the way back goes through
    the sets of sums before each lot.
    """
    mask, reach, goal = (1 << (room + 1)) - 1, 1, 1 << room
    lots: list[tuple[int, int, int]] = []
    for length in lengths:
        most, lot = min(counts[length], room // length), 1
        while most > 0:
            lot = min(lot, most)
            lots.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            most -= lot
            lot *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, lot, before in reversed(lots):
        if not before >> total & 1:
            total -= length * lot
            used[length] = used.get(length, 0) + lot
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for all pieces, from how many there are of each length.

    A bin starts with the longest piece left and takes the fullest combination of the
    others. The same combination is repeated while the counts last, so the number of
    plans follows the number of lengths, not of pieces.
    """
    left, taken = dict(histogram), dict.fromkeys(histogram, 0)
    order = sorted(left, reverse=True)
    slots, sequence = [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        room = capacity - longest
        used = fullest([x for x in order if x <= room and left[x]], left, room) if room else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[x] // k for x, k in used.items())
        offset = 0
        for length, each in used.items():
            slots.append(Slot(length, taken[length], sequence, each, offset))
            offset += length * each
            taken[length] += bins * each
            left[length] -= bins * each
        sequence += bins
        order = [x for x in order if left[x]]
    return slots


RANKS = 1 << 40


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; ``pieces`` needs a column ``length``.

    The driver sees only the histogram of lengths, at most ``capacity`` rows. A piece's
    rank among those of its length is its rank inside its stored partition plus the
    counts of the partitions before it, so no task sorts all pieces of one length.
    """
    ship_package(pieces.sparkSession)
    stored = durable(pieces.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")
    counts = durable(stored.groupBy(part, "length").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots = sorted(plan_bins({r["length"]: r["n"] for r in totals}, capacity))
    table = np.array(slots or [(0, 0, 0, 1, 0)], dtype="int64")
    plan = pieces.sparkSession.sparkContext.broadcast(table)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("p"), F.col("length").alias("l"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part", "length").orderBy("place")
    ranked = stored.select("*", part).withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def place_of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slot = plan.value
        keys = slot[:, 0] * RANKS + slot[:, 1]
        length, rank = length.to_numpy(), rank.to_numpy()
        own = slot[np.searchsorted(keys, length * RANKS + rank, side="right") - 1]
        index = rank - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + index // own[:, 3],
                             "offset": own[:, 4] + index % own[:, 3] * length})

    placed = ranked.withColumn("at", place_of("length", "rank"))
    return placed.select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents of more
    than ``capacity`` ids, and only those, are cut. A null or empty text is the one id at
    the end. Repeated rows and null ids are pieces like all others. An empty table gives
    no rows; columns other than the two named are not read.
    """
    return pack_pieces(token_pieces(df, tokenizer_path, capacity, id_col, text_col), capacity)
