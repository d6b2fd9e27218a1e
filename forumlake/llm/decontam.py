"""Benchmark decontamination by a BM25 index of the test items with block maxima.

Items are the documents of the index and passages of the training texts its queries. The
weights of an item are divided by its score for itself, so one threshold holds for all.
A passage is first bounded by the largest weight of each of its terms, then by the
largest weight in each block of items, and scored exactly only for the blocks that can
still reach the threshold. Nothing above the threshold is missed. What is
retrieved must then share runs of words with the question and with the answer.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import all_columns, free_name, ship_package
from forumlake.llm.words import hashed_words, shingles_of
from forumlake.session import durable

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Runs of so many words are compared, and so much of the question and of the answer, or of
#: the whole item, must be found.
RUN = 5
PART_SHARE, WHOLE_SHARE = 0.5, 0.75
#: Longer items are retrieved by pieces of so many words, one every PIECE_STEP, and then compared
#: as a whole and in every stretch of so many words. Items of fewer words than a run are one run.
MOST_WORDS = 256
PIECE_STEP = 64
BLOCK = 16
#: Bytes of items in one index. A larger benchmark is searched as several indexes, with the same
#: results, since all use the statistics of the whole.
INDEX_BYTES = 8_000_000
CHUNK = 8 << 20

# Bytes that part words: all of ASCII but letters and digits. Texts are lower-cased before.
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_VALUES = np.arange(1, 257, dtype="uint64")
# Scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters. Each of
# their characters is a word, and their punctuation parts words.
_UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_WIDE_GAPS = re.compile("[\u3000-\u3003\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])|\n+")


def coded(text: str | None) -> bytes:
    if not text:
        return b""
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", _WIDE_GAPS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass")


def words_in(text: str) -> np.ndarray:
    return next(hashed_words([coded(text)], _GAPS, _VALUES))[0]


class Item(NamedTuple):
    """What is compared; without an answer only the whole is."""

    item_id: int
    size: int  # words
    question: np.ndarray  # runs
    answer: np.ndarray
    whole: np.ndarray  # runs in their order
    sizes: tuple[int, int]  # words of question and answer


class Entry(NamedTuple):
    """An item, or a piece of a long one, as it is retrieved."""

    words: np.ndarray
    item: Item


class Index(NamedTuple):
    entries: list[Entry]
    terms: np.ndarray  # sorted word hashes
    most: np.ndarray  # largest weight of a term in any entry
    starts: np.ndarray  # of a term's postings
    holders: np.ndarray  # entry of each posting
    weights: np.ndarray
    block_starts: np.ndarray  # of a term's blocks
    blocks: np.ndarray
    block_most: np.ndarray
    stride: int


def entries_of(item_id: int, text: str | None) -> list[Entry]:
    """The answer is the last sentence, the question what comes before it."""
    words = words_in(text or "")
    if not len(words):
        return []
    sentences = [s for s in _SENTENCES.split(text) if len(words_in(s))]
    n = len(words_in(sentences[-1])) if len(sentences) > 1 else 0
    question, answer = (words[:-n], words[-n:]) if n else (words, words[:0])
    item = Item(item_id, len(words), np.unique(shingles_of(question, RUN)), np.unique(shingles_of(answer, RUN)),
                shingles_of(words, RUN), (len(question), len(answer)))
    last = max(0, len(words) - MOST_WORDS)
    return [Entry(words[i : i + MOST_WORDS], item) for i in [*range(0, last, PIECE_STEP), last]]


class Whole(NamedTuple):
    """What an index of a part has to know of all items."""

    entries: int
    words: int
    longest: int
    terms: np.ndarray  # sorted, at least those of the part
    df: np.ndarray


def whole_of(entries: list[Entry]) -> Whole:
    known, df = np.unique(np.concatenate([np.unique(e.words) for e in entries] or [np.zeros(0, "uint64")]),
                          return_counts=True)
    return Whole(len(entries), sum(len(e.words) for e in entries), max([RUN, *(len(e.words) for e in entries)]), known, df)


def build_index(items: list[tuple[int, str | None]], whole: Whole | None = None) -> Index:
    """An index of the items, which are all there are or those of a part of the ``whole``."""
    entries = [e for i, t in items for e in entries_of(i, t)]
    whole = whole or whole_of(entries)
    known, df = whole.terms, whole.df
    # Neighbours share blocks: entries with the same frequent words bound each other best.
    entries.sort(key=lambda e: (int(e.words[np.argmax(df[np.searchsorted(known, e.words)])]), len(e.words)))
    mean = whole.words / max(1, whole.entries)
    rows = []
    for at, entry in enumerate(entries):
        terms, tf = np.unique(entry.words, return_counts=True)
        term = np.searchsorted(known, terms)
        idf = np.log1p((whole.entries - df[term] + 0.5) / (df[term] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(entry.words) / mean))
        rows.append((term, np.full(len(term), at), weight / weight.sum()))
    term, holder, weight = (np.concatenate(c) if rows else np.zeros(0, t) for c, t in zip(
        list(zip(*rows, strict=True)) or [(), (), ()], ("int64", "int64", "float64"), strict=True))
    order = np.lexsort((holder, term))
    term, holder, weight = term[order], holder[order], weight[order]
    most = np.zeros(len(known))
    np.maximum.at(most, term, weight)
    n_blocks = len(entries) // BLOCK + 1
    keys, where = np.unique(term * n_blocks + holder // BLOCK, return_inverse=True)
    block_most = np.zeros(len(keys))
    np.maximum.at(block_most, where, weight)
    edges = np.arange(len(known) + 1)
    entries = [e._replace(words=e.words[:0].copy()) for e in entries]  # they are in the postings
    return Index(entries, known, most, np.searchsorted(term, edges), holder, weight,
                 np.searchsorted(keys // n_blocks, edges), keys % n_blocks, block_most, whole.longest)


def spread(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term all places of its list: which of ``terms`` and where."""
    counts = starts[terms + 1] - starts[terms]
    which = np.repeat(np.arange(len(terms)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return which, np.arange(len(which)) - first + starts[terms][which]


def retrieve(words: np.ndarray, cuts: np.ndarray, index: Index) -> list[tuple[int, int, int, float]]:
    """Text, first word of the passage, entry and score of all passages above the threshold.

    Passages are two strides long and begin every stride, so any run of words as long as the
    longest entry is whole in one of them.
    """
    stride = index.stride
    lengths = np.diff(cuts)
    cells = np.maximum(1, -(-lengths // stride))  # of each text
    first_cell = np.concatenate([[0], np.cumsum(cells)])
    found = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    place = np.flatnonzero(index.terms[found] == words)
    if not len(place):
        return []
    text = np.searchsorted(cuts, place, side="right") - 1
    cell = first_cell[text] + (place - cuts[text]) // stride
    # A cell is the end of the passage before it too, but for the first cell of a text.
    starts_text = np.zeros(first_cell[-1] + 1, bool)
    starts_text[first_cell] = True
    back = ~starts_text[cell]
    n_terms = len(index.terms)
    keys = np.unique(np.concatenate([cell, cell[back] - 1]) * n_terms + np.concatenate([found[place], found[place][back]]))
    passage, term = keys // n_terms, keys % n_terms
    bound = np.bincount(passage, index.most[term], first_cell[-1])
    alive = bound[passage] >= THRESHOLD
    passage, term = passage[alive], term[alive]
    n_blocks = len(index.entries) // BLOCK + 1
    which, at = spread(index.block_starts, term)
    pairs, where = np.unique(passage[which] * n_blocks + index.blocks[at], return_inverse=True)
    bound = np.bincount(where, index.block_most[at], len(pairs))
    pairs = pairs[bound >= THRESHOLD]
    if not len(pairs):
        return []
    alive = np.isin(passage, pairs // n_blocks)
    passage, term = passage[alive], term[alive]
    which, at = spread(index.starts, term)
    here = np.isin(passage[which] * n_blocks + index.holders[at] // BLOCK, pairs)
    which, at = which[here], at[here]
    n = len(index.entries)
    keys, where = np.unique(passage[which] * n + index.holders[at], return_inverse=True)
    score = np.bincount(where, index.weights[at], len(keys))
    out = []
    for key, s in zip(keys[score >= THRESHOLD], score[score >= THRESHOLD], strict=True):
        own = int(np.searchsorted(first_cell, key // n, side="right") - 1)
        out.append((own, int(cuts[own] + (key // n - first_cell[own]) * stride), int(key % n), float(s)))
    return out


def share(wanted: np.ndarray, words: np.ndarray, width: int) -> float:
    if not len(wanted):
        return 0.0
    return float(np.isin(wanted, shingles_of(words, width)).mean())


def stretch_share(found: np.ndarray) -> float:
    """The largest share of an item's runs that are found in a stretch of MOST_WORDS of its words."""
    width = min(len(found), MOST_WORDS - RUN + 1)
    sums = np.concatenate([[0], np.cumsum(found)])
    return float((sums[width:] - sums[:-width]).max() / width)


def verified(item: Item, passage: np.ndarray) -> tuple[float, float] | None:
    """The shares of question and answer in a passage, if that is enough."""
    question = share(item.question, passage, min(RUN, item.sizes[0]))
    answer = share(item.answer, passage, min(RUN, item.sizes[1]))
    enough = min(question, answer) >= PART_SHARE
    if not enough:
        runs = shingles_of(passage, min(RUN, item.size))
        if item.size <= MOST_WORDS:
            enough = np.isin(np.unique(item.whole), runs).mean() >= WHOLE_SHARE
        else:
            enough = stretch_share(np.isin(item.whole, runs)) >= WHOLE_SHARE
    return (question, answer) if enough else None


def search(texts: list[str | None], index: Index) -> list[list[dict]]:
    """The verified items of each text: item_id, score, question, answer (shares found).

    A short item is compared with the passage that retrieved it; a long one with the text
    around, its own length to both sides.
    """
    out: list[list[dict]] = []
    for words, cuts in hashed_words(map(coded, texts), _GAPS, _VALUES):
        best: list[dict[int, dict]] = [{} for _ in cuts[1:]]
        # Pieces of a long item that are found near each other are compared once.
        scores: dict[tuple[int, int, int, int], float] = {}
        items: dict[int, Item] = {}
        for text, start, at, score in retrieve(words, cuts, index) if index.entries else []:
            item = index.entries[at].item
            first, last = start, start + 2 * index.stride
            if item.size > MOST_WORDS:
                own = int(cuts[text])
                near = own + (start - own) // item.size * item.size
                first, last = max(own, near - item.size), near + 2 * item.size + 2 * index.stride
            items[id(item)] = item
            key = (text, id(item), first, min(last, int(cuts[text + 1])))
            scores[key] = max(score, scores.get(key, 0.0))
        for (text, at, first, last), score in scores.items():
            item = items[at]
            own = best[text].get(item.item_id)
            if own is not None and score <= own["score"]:
                continue
            shares = verified(item, words[first:last])
            if shares:
                best[text][item.item_id] = {
                    "item_id": item.item_id, "score": score, "question": shares[0], "answer": shares[1]}
        out.extend([[own[i] for i in sorted(own)] for own in best])
    return out


HITS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def parts_of(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The different items with an id: id, text and the part by a hash of the id, and how many parts."""
    ship_package(items.sparkSession)
    size = items.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = size // INDEX_BYTES + 1
    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n))), n


def hits_column(text: Column, items: DataFrame) -> Column:
    """The items found in a text, for items of one part."""
    rows = items.select("id", "text").collect()
    return _search_column(text, items.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in rows])))


def stored_indexes(items: DataFrame) -> DataFrame:
    """part, seq and data: the index of each part in chunks, built in a task for each and stored.

    Document frequencies, lengths and the number of entries are those of all items.
    """
    items = durable(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, own in batch.groupby("part"):
                whole = whole_of([e for t in own["text"] for e in entries_of(0, t)])
                terms = pd.DataFrame({"part": part, "term": pd.array(whole.terms.view("int64"), "Int64"), "n": whole.df,
                                      "words": 0, "longest": RUN})
                total = pd.DataFrame({"part": [part], "term": pd.array([None], "Int64"), "n": [whole.entries],
                                      "words": [whole.words], "longest": [whole.longest]})
                yield pd.concat([terms, total])

    counted = durable(items.mapInPandas(count, "part long, term long, n long, words long, longest long"))
    total = counted.where("term IS NULL").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    entries, words, longest = (total[0] or 0), (total[1] or 0), (total[2] or RUN)
    df = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    terms = counted.where("term IS NOT NULL").select("part", "term").distinct().join(df, "term")

    def build(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(known["term"].to_numpy("int64").view("uint64"))
        whole = Whole(entries, words, longest, known["term"].to_numpy("int64").view("uint64")[order],
                      known["n"].to_numpy("int64")[order])
        data = pickle.dumps(build_index(list(zip(own["id"].tolist(), own["text"], strict=True)), whole))
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return pd.DataFrame({"part": own["part"].iloc[0] if len(own) else known["part"].iloc[0],
                             "seq": range(len(chunks)), "data": chunks})

    return durable(items.groupBy("part").cogroup(terms.groupBy("part")).applyInPandas(
        build, "part long, seq long, data binary"))


def found_by_parts(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """key and hits of the rows of ``texts`` (key string, text), one row for each part that has hits.

    Each part meets the texts in several cells. A cell's index comes before its texts in one
    sorted partition, so a task holds one index at a time and none passes through the driver.
    """
    cells = texts.sparkSession.sparkContext.defaultParallelism
    indexes = stored_indexes(items).select(
        F.explode(F.expr(f"sequence(part * {cells}, part * {cells} + {cells - 1})")).alias("cell"), "seq", "data",
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"))
    salt = F.pmod(F.xxhash64("key", "text"), F.lit(cells))
    wanted = texts.select("key", "text").where("text IS NOT NULL").withColumn("salt", salt).select(
        F.explode(F.expr(f"transform(sequence(0L, {n - 1}L), p -> p * {cells} + salt)")).alias("cell"),
        F.lit(1 << 40).cast("long").alias("seq"), F.lit(None).cast("binary").alias("data"), "key", "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, waiting, index = None, [], None
        for batch in batches:
            for at, own in batch.groupby("cell", sort=True):
                if at != cell:
                    cell, waiting, index = at, [], None
                is_index = own["data"].notna()
                waiting.extend(own["data"][is_index])
                rows = own[~is_index]
                if not len(rows):
                    continue
                if index is None and waiting:
                    index, waiting = pickle.loads(b"".join(waiting)), []
                if index is not None:  # a part without items has none
                    hits = pd.Series(search(list(rows["text"]), index), dtype=object)
                    out = pd.DataFrame({"key": rows["key"].to_numpy(), "hits": hits})
                    yield out[hits.map(len) > 0]

    both = indexes.unionByName(wanted).repartition("cell").sortWithinPartitions("cell", "seq")
    return both.mapInPandas(read, f"key string, hits {HITS}")


def _search_column(text: Column, shared) -> Column:
    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(search(list(batch), shared.value), index=batch.index, dtype=object)

    return found(text)


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, question, answer.

    ``score`` is the share of the item's own BM25 score, ``question`` and ``answer`` the shares
    of their runs of words that one passage has. Documents without a leak give no row.
    Null or empty texts and items, items without an id or without words, and empty tables
    give none; repeated documents each give their own. Items of fewer than five words are found
    word for word. In scripts without spaces each character counts as a word.
    """
    rows, n = parts_of(items, item_id_col, item_text_col)
    if n == 1:
        found = df.select(F.col(id_col).alias("doc_id"), hits_column(F.col(text_col), rows).alias("hits"))
    else:
        texts = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
        found = found_by_parts(texts, rows, n).select(
            F.col("key").cast(df.schema[id_col].dataType).alias("doc_id"), "hits")
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def drop_leaks(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``df`` in which no item is found, with all columns."""
    name = free_name(df.columns, "hits")
    rows, n = parts_of(items, item_id_col, item_text_col)
    if n > 1:
        digest = F.sha2(F.col(text_col), 256)
        texts = df.select(digest.alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
        leaks = durable(found_by_parts(texts, rows, n).select(F.col("key").alias(name)).distinct())
        return df.withColumn(name, digest).join(leaks, name, "left_anti").select(*all_columns(df))
    hits = hits_column(F.col(text_col), rows)
    return df.withColumn(name, hits).where(F.size(name) == 0).select(*all_columns(df))
