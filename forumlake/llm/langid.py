"""Language identification by interpolated Kneser-Ney character models.

A model of order n is trained per language on words with borders, ``^^^word$``. All
languages share, for each order, one sorted array of n-gram hashes; beside it lie the
logarithms of the interpolated probabilities, one column per language, so a lookup is a
binary search. An n-gram that no language has seen backs off through a second array of
context weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forumlake.llm.common import all_columns, free_name, lean, ship_package
from forumlake.session import durable

ORDER = 4
#: Bounds of the labelled sample: documents per language for the counts and for the
#: calibration, and the most characters a sampled document may have (longer ones are
#: passed over, none is cut).
TRAIN_DOCS = 1_000
CALIBRATION_DOCS = 500
SAMPLE_CHARS = 10_000
#: A text is rejected if its cross-entropy lies above so much of the way from what texts of
#: its language have to what texts of the nearest other language have under the same model,
#: and more than so many standard errors of its own length above that. Texts with passages
#: in another language stay; texts in a language that was not learned do not.
REJECT_AT = 0.75
STANDARD_ERRORS = 4.0
#: The score counts the evidence of at most so many characters.
SCORE_CHARS = 100

# Characters that count as parts of words elsewhere, but are numbers: fractions, powers, circled ones.
NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
# Sets of plain characters are looked up at once, without the rare ones behind U+FFFF. Beside
# classes like \W each character would be compared with all of them.
NUMBER = re.compile(f"[{''.join(c for c in NUMBERS if c <= chr(0xFFFF))}]")
RARE = re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]")
RARE_NUMBER = re.compile(f"[{''.join(c for c in NUMBERS if c > chr(0xFFFF))}]")
# Letters next to digits belong to codes and are not words of a language.
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
LETTER = re.compile(r"[^\W\d_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():  # numbers of every kind part words as digits do
        text = NUMBER.sub("0", text)
        if RARE.search(text):
            text = RARE_NUMBER.sub("0", text)
    return WORD.findall(text) or LETTER.findall(text)


class Level(NamedTuple):
    grams: np.ndarray  # sorted hashes
    logs: np.ndarray  # (grams, languages)
    contexts: np.ndarray  # sorted hashes
    weights: np.ndarray  # (contexts, languages)


class Model(NamedTuple):
    languages: list[str]
    levels: list[Level]  # order 1 first
    unseen: float
    limit: np.ndarray  # highest usual cross-entropy, by language
    spread: np.ndarray  # variance of the cross-entropy of one word


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` codes that end at each place."""
    out = np.zeros(len(codes), "uint64")
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(codes), "uint64")
        shifted[back:] = codes[: len(codes) - back]
        out = (out + shifted + np.uint64(1)) * STEP
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")


def hash_of(grams: list[str], order: int) -> np.ndarray:
    if not grams or not order:
        return np.zeros(len(grams), "uint64")
    return gram_hashes(codes_of("".join(grams)), order)[order - 1 :: order]


def kneser_ney(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """The model of n-gram counts by language. Counts of lower orders are numbers of different
    letters in front, as the method has it; each order has its own discount per language."""
    languages = sorted(counts)
    tables = [dict(counts[x]) for x in languages]
    by_order = {order: tables}
    for k in range(order - 1, 0, -1):
        tables = []
        for above in by_order[k + 1]:
            own: dict[str, int] = {}
            for gram in above:
                own[gram[1:]] = own.get(gram[1:], 0) + 1
            tables.append(own)
        by_order[k] = tables
    letters = len({g for own in by_order[1] for g in own}) + 1
    place: dict[str, int] = {"": 0}
    lower = np.full((1, len(languages)), 1 / letters)
    levels = []
    for k in range(1, order + 1):
        grams = sorted({g for own in by_order[k] for g in own})
        contexts = sorted({g[:-1] for g in grams})
        at = {c: i for i, c in enumerate(contexts)}
        context = np.array([at[g[:-1]] for g in grams], "int64")
        suffix = np.array([place[g[1:]] for g in grams], "int64")
        count = np.array([[own.get(g, 0) for own in by_order[k]] for g in grams], float)
        count = count.reshape(len(grams), len(languages))
        ones, twos = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        total = np.zeros((len(contexts), len(languages)))
        kinds = np.zeros_like(total)
        np.add.at(total, context, count)
        np.add.at(kinds, context, count > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        known = np.maximum(count - discount, 0) / np.maximum(total[context], 1)
        share = known + weight[context] * lower[suffix]
        g_hash, c_hash = hash_of(grams, k), hash_of(contexts, k - 1)
        g, c = np.argsort(g_hash), np.argsort(c_hash)
        levels.append(Level(g_hash[g], np.log(share[g]), c_hash[c], np.log(weight[c])))
        place, lower = {x: i for i, x in enumerate(grams)}, share
    uniform = np.full(len(languages), math.log(letters))
    return Model(languages, levels, -math.log(letters), uniform, np.zeros(len(languages)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def word_logs(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word under each language; (words, languages)."""
    order = len(model.levels)
    front = "^" * (order - 1)
    codes = codes_of("".join([f"{front}{w}$" for w in words]))
    lengths = np.array([len(w) for w in words]) + order
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = np.ones(len(codes), bool)
    for i in range(order - 1):
        inside[starts + i] = False
    places = np.flatnonzero(inside)
    logs = np.zeros((len(places), len(model.languages)))
    open_ = np.arange(len(places))
    for k in range(order, 0, -1):
        level = model.levels[k - 1]
        at, found = _find(level.grams, gram_hashes(codes, k)[places[open_]])
        logs[open_[found]] += level.logs[at[found]]
        open_ = open_[~found]
        if not len(open_):
            break
        if k == 1:
            logs[open_] += level.weights[0] + model.unseen
        else:
            at, found = _find(level.contexts, gram_hashes(codes, k - 1)[places[open_] - 1])
            logs[open_[found]] += level.weights[at[found]]
    first = starts - np.arange(len(words)) * (order - 1)
    return np.add.reduceat(logs, first, axis=0)


class Scorer:
    """Sums of word logs by text; words met before are not scored again."""

    def __init__(self, model: Model, most_words: int = 300_000):
        self.model, self.most = model, most_words
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability by text and language, and the number of characters with borders."""
        new = list({w for words in texts for w in words if w not in self.row})
        if len(self.row) + len(new) > self.most:
            self.clear()
            new = list({w for words in texts for w in words})
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, word_logs(new, self.model)])
        total = np.zeros((len(texts), len(self.model.languages)))
        chars = np.zeros(len(texts))
        for i, words in enumerate(texts):
            if words:
                rows = np.fromiter(map(self.row.__getitem__, words), "int64", len(words))
                total[i] = self.logs[rows].sum(0)
                chars[i] = sum(map(len, words)) + len(words)
        return total, chars


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column) -> DataFrame:
    """A bounded sample of labelled documents: language, whether for calibration, text.

    Documents are taken in the order of a hash of their id. A quarter of the ids is set
    aside for the calibration. Only ids and labels are ranked; texts follow for the chosen.
    """
    pick = F.xxhash64(F.col(id_col))
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(4)) == 0
    fit = (usable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()
           & (F.length(text_col) <= SAMPLE_CHARS))
    rows = df.where(fit).select(F.col(lang_col).alias("lang"), fold.alias("later"), pick.alias("pick"))
    # Ranked in 64 parts first, so that few rows of a frequent language meet in one task.
    part = Window.partitionBy("lang", "later", F.pmod("pick", F.lit(64))).orderBy("pick")
    rows = rows.withColumn("rank", F.row_number().over(part)).where(
        F.col("rank") <= max(TRAIN_DOCS, CALIBRATION_DOCS))
    order = Window.partitionBy("lang", "later").orderBy("pick")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= F.when(F.col("later"), CALIBRATION_DOCS).otherwise(TRAIN_DOCS)
    ).where(F.col("rank") <= max(TRAIN_DOCS, CALIBRATION_DOCS))
    chosen = ranked.select("pick").distinct()
    texts = df.where(fit).select(pick.alias("pick"), F.col(lang_col).alias("lang"),
                                 fold.alias("later"), F.col(text_col).alias("text"))
    return durable(texts.join(F.broadcast(chosen), "pick", "left_semi").dropDuplicates(["pick"]))


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    usable: Column | None = None,
) -> Model:
    """A model of the labelled rows of ``df`` for which ``usable`` holds.

    N-grams are counted in Spark; what reaches the driver is bounded by the sample. Rows with
    a null id, text or label are not learned from. Without any the model knows no language.
    """
    ship_package(df.sparkSession)
    usable = F.lit(True) if usable is None else usable
    rows = sample(df, id_col, text_col, lang_col, F.coalesce(usable, F.lit(False)))

    @lean
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for word in words_of(text):
                    padded = "^" * (ORDER - 1) + word + "$"
                    for i in range(len(padded) - ORDER + 1):
                        key = (lang, padded[i : i + ORDER])
                        seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "gram", "n"])

    counted = rows.where("NOT later").select("lang", "text").mapInPandas(
        grams, "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in counted.groupBy("lang", "gram").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(lang, {})[gram] = n
    model = kneser_ney(counts)
    return calibrated(model, rows.where("later").select("lang", "text")) if counts else model


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with the usual cross-entropy of texts that it was not trained on."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @lean
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = words_of(text)
                if len(words) < 2:
                    continue
                logs = -word_logs(words, model)
                chars = np.array([len(w) + 1 for w in words])
                h = logs.sum(0) / chars.sum()
                off = ((logs - h * chars[:, None]) ** 2).sum(0) / chars.sum() ** 2 * len(words)
                out.extend((lang, x, float(h[i]), float(off[i])) for i, x in enumerate(model.languages))
            yield pd.DataFrame(out, columns=["lang", "under", "h", "off"])

    texts = rows.mapInPandas(measure, "lang string, under string, h double, off double")
    found = {(r["lang"], r["under"]): r for r in texts.groupBy("lang", "under").agg(
        F.avg("h").alias("h"), F.avg("off").alias("off")).collect()}
    limit, spread = model.limit.copy(), model.spread.copy()
    for i, x in enumerate(model.languages):
        if (x, x) in found:
            other = [r["h"] for (lang, under), r in found.items() if under == x and lang != x]
            own = found[x, x]["h"]
            limit[i] = own + REJECT_AT * (min(other, default=-model.unseen) - own)
            spread[i] = found[x, x]["off"]
    return model._replace(limit=limit, spread=spread)


def judge(totals: np.ndarray, chars: np.ndarray, n_words: np.ndarray, model: Model):
    """Best language, score and whether the text is accepted, for texts with words."""
    entropy = -totals / chars[:, None]
    best = entropy.argmin(1)
    lowest = entropy[np.arange(len(best)), best]
    weight = np.minimum(chars, SCORE_CHARS)
    score = 1 / np.exp(-(entropy - lowest[:, None]) * weight[:, None]).sum(1)
    error = np.sqrt(model.spread[best] / n_words)
    return best, score, lowest <= model.limit[best] + STANDARD_ERRORS * error


def language_columns(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of structs: lang, score, entropy, accepted.

    The language is the one with the lowest cross-entropy per character. A null text, or one
    without letters (or a model without languages), is ``und`` with score 0 and is rejected.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, entropy double, accepted boolean")
    @lean
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            langs, scores, entropies, accepted = [], [], [], []
            for part in in_lots(batch):
                words = [words_of(t) if t and model.languages else [] for t in part]
                totals, chars = scorer(words)
                n = np.array([len(w) for w in words])
                with_words = n > 0 if model.languages else np.zeros(len(n), bool)
                own = np.flatnonzero(with_words)
                lang, score = np.full(len(n), "und", object), np.zeros(len(n))
                h, ok = np.full(len(n), np.nan), np.zeros(len(n), bool)
                if len(own):
                    best, score[own], ok[own] = judge(totals[own], chars[own], n[own], model)
                    lang[own] = [model.languages[b] for b in best]
                    h[own] = -totals[own, best] / chars[own]
                langs.extend(lang)
                scores.extend(score)
                entropies.extend(h)
                accepted.extend(ok)
            yield pd.DataFrame({"lang": langs, "score": scores, "entropy": entropies, "accepted": accepted})

    return identify(F.col(text_col))


def in_lots(batch: pd.Series, chars: int = 1_000_000) -> Iterator[list]:
    """The texts of a batch in lots of about so many characters, to bound the word lists."""
    lot, size = [], 0
    for text in batch:
        lot.append(text)
        size += len(text) if text else 0
        if size >= chars:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def identify_languages(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang, score, entropy, accepted of each row; an empty table gives none."""
    found = language_columns(df, model, text_col)
    out = df.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return out.select("doc_id", "found.*")


def keep_accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the model accepts, with all their columns."""
    name = free_name(df.columns, "language")
    found = df.withColumn(name, language_columns(df, model, text_col))
    return found.where(F.col(name)["accepted"]).select(*all_columns(df))
