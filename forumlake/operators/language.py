"""Language detection: naive Bayes over letter trigrams, learned from labelled text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.operators.joins import broadcast_if_small
from forumlake.session import durable

# Log probabilities are kept as whole millionths: sums then do not depend on order.
SCALE = 1_000_000
# Words whose sums are worked out beforehand; all others go through their trigrams.
COMMON_WORDS = 50_000
# Numbers in a broadcast table: rows times languages.
BROADCAST_CELLS = 8_000_000


@dataclass
class Profiles:
    """``grams`` (gram, lp0, lp1, …) and ``words`` (word, lp0, …), one column per language."""

    grams: DataFrame
    words: DataFrame
    langs: list[str]

    @property
    def columns(self) -> list[str]:
        return [f"lp{i}" for i in range(len(self.langs))]


def words_of(text) -> Column:
    """Runs of letters in lower case; text without letters gives one empty word."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.trim(F.regexp_replace(F.lower(c), r"\P{L}+", " ")), " ")


def trigrams(word) -> Column:
    """Overlapping runs of three characters of a word with a blank on each side."""
    c = F.col(word) if isinstance(word, str) else word
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(r"(?=(...))"), F.lit(1))


def train_profiles(labelled: DataFrame, text: str, lang: str) -> Profiles:
    """Learn from all of ``labelled`` with the add-one rule.

    Text is reduced to word counts per language in the map tasks; trigrams are
    cut from distinct words only.
    """
    counted = durable(
        labelled.filter(F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), F.explode(words_of(text)).alias("word"))
        .filter("word <> ''")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    )
    langs = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        raise ValueError("the language column holds no value")
    table = durable(
        counted.select("lang", "c", F.explode(trigrams("word")).alias("gram"))
        .groupBy("gram").agg(*[
            F.sum(F.when(F.col("lang") == n, F.col("c")).otherwise(0)).alias(f"n{i}")
            for i, n in enumerate(langs)
        ])
    )
    sizes = table.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))]
    ).first()
    grams = table.select("gram", *[
        F.round(F.log(
            (F.col(f"n{i}") + 1).cast("double") / F.lit(float((sizes[f"n{i}"] or 0) + sizes["v"]))
        ) * SCALE).cast("bigint").alias(f"lp{i}")
        for i in range(len(langs))
    ])
    found = Profiles(grams, grams, langs)
    common = (
        _common_words(counted, min(COMMON_WORDS, BROADCAST_CELLS // len(langs)))
        .select("word", F.explode(trigrams("word")).alias("gram"))
        .join(broadcast_if_small(grams, BROADCAST_CELLS // len(langs)), "gram")
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in found.columns])
    )
    return Profiles(grams, durable(common), langs)


def save_profiles(profiles: Profiles, folder: str) -> None:
    """Store what was learned, so that later jobs only score."""
    profiles.grams.write.mode("errorifexists").parquet(f"{folder}/grams")
    profiles.words.write.mode("errorifexists").parquet(f"{folder}/words")
    langs = profiles.grams.sparkSession.createDataFrame(list(enumerate(profiles.langs)), "at int, lang string")
    langs.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/langs")


def load_profiles(spark: SparkSession, folder: str) -> Profiles:
    langs = spark.read.parquet(f"{folder}/langs").orderBy("at").collect()
    grams, words = (spark.read.parquet(f"{folder}/{name}") for name in ("grams", "words"))
    return Profiles(grams, words, [r["lang"] for r in langs])


def _common_words(counted: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` words that are frequent in some language.

    The frequency that separates them comes from a histogram over quarter powers
    of two, a few hundred rows, so the words are neither sorted nor moved.
    """
    sized = counted.select("word", F.floor(F.log2("c") * 4).alias("size"))
    histogram = sized.groupBy("size").count().collect()
    least, words = None, 0
    for size, n in sorted(((r["size"], r["count"]) for r in histogram), reverse=True):
        words += n
        if words > limit:
            break
        least = size
    common = sized.filter(F.lit(False) if least is None else F.col("size") >= least)
    return common.select("word").distinct()


def detect_language(
    items: DataFrame, key: str, text: str, profiles: Profiles, out: str = "detected"
) -> DataFrame:
    """(key, detected): the language with the largest sum; the first by name on a tie.

    Text without a known trigram gives NULL. Common words take their sums from a
    table of at most ``COMMON_WORDS`` rows, other words from their trigrams. The
    words of a text stand next to each other, so the sums are nearly complete
    before the shuffle.
    """
    lps = profiles.columns
    words = F.broadcast(profiles.words.withColumnsRenamed({c: f"w{c}" for c in lps}))
    tokens = items.select(key, F.explode_outer(words_of(text)).alias("word")).join(
        words, "word", "left"
    )
    rare = F.when(F.col("w" + lps[0]).isNull(), trigrams("word"))
    grams = tokens.select(key, *[f"w{c}" for c in lps], F.explode_outer(rare).alias("gram"))
    scored = grams.join(
        broadcast_if_small(profiles.grams, BROADCAST_CELLS // len(lps)), "gram", "left"
    )
    sums = scored.groupBy(key).agg(
        *[F.sum(F.coalesce(f"w{c}", c)).alias(f"s{i}") for i, c in enumerate(lps)]
    )
    best = F.array_max(F.array(*[
        F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("lang"))
        for i, n in enumerate(profiles.langs)
    ]))
    return sums.select(key, F.when(F.col("s0").isNotNull(), best["lang"]).alias(out))
