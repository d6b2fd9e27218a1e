"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that are replaced, in this order, and what they become.
BOILERPLATE = (
    "As an AI language model, I don't have personal preferences or feelings. However,",
    "As an AI language model, I don't have personal preferences or opinions, but ",
    "I'm sorry to hear you're feeling that way! As an AI language model, I don't have access to real-time information on Hypmic or its future plans. However,",
    "As an AI language model, I don't have personal beliefs or experiences. However,",
    "I'm just an AI, I don't have personal beliefs or opinions, and I cannot advocate for or against any particular religion. However,",
    "As an AI, I don't have real-time information on specific individuals or their projects. However,",
)
BOILERPLATE_REPLACEMENT = "FWIW - "

# A word is a run without white space (Unicode white space and the
# four separators 1c to 1f), a mark is one of the 32 ASCII punctuation marks.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
MARK_PATTERN = r"\p{Punct}"

LINE_WIDTH = 80


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(text) -> Column:
    return reduce(
        lambda c, phrase: F.replace(c, F.lit(phrase), F.lit(BOILERPLATE_REPLACEMENT)),
        BOILERPLATE,
        _col(text),
    )


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(WORD_PATTERN))


def punctuation_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(MARK_PATTERN))


def format_width(text) -> Column:
    """First ceil(length / 80) lines, each cut to 80; every line after the first is
    set on a new line behind (80 - its length) spaces. Missing lines count as
    empty ones. Empty text gives NULL."""
    c = _col(text)
    wanted = F.floor((F.length(c) + LINE_WIDTH - 1) / LINE_WIDTH).cast("int")
    lines = F.slice(F.split(c, "\n"), F.lit(1), wanted)
    lines = F.concat(lines, F.array_repeat(F.lit(""), wanted - F.size(lines)))

    def place(line, i):
        cut = F.substring(line, 1, LINE_WIDTH)
        pad = F.repeat(F.lit(" "), LINE_WIDTH - F.length(cut))
        return F.when(i == 0, cut).otherwise(F.concat(F.lit("\n"), pad, cut))

    return F.when(F.length(c) > 0, F.array_join(F.transform(lines, place), ""))


def parent_comment_id(parent_id) -> Column:
    """The id behind the type prefix of ``t1_abc``."""
    return F.split_part(_col(parent_id), F.lit("_"), F.lit(2))


def index_prefix(text) -> Column:
    return F.left(_col(text), F.lit(255))


def title_and_body(title, body, separator: str = "") -> Column:
    """NULL when either part is NULL."""
    return F.concat(_col(title), F.lit(separator), _col(body))


def edited_text(edited) -> Column:
    """``false`` for never edited, otherwise the epoch in whole seconds as text.

    The feed gives a boolean or a number; both reach here as text.
    """
    c = F.lower(_col(edited).cast("string"))
    epoch = c.try_cast("double")
    return F.when(
        c.isNull() | (c == "false") | (epoch == 0), "false"
    ).when(c == "true", "1").otherwise(epoch.cast("bigint").cast("string"))


def internal_id(key, seed: int = 0) -> Column:
    """Ten repeatable letters and digits per key."""
    return F.substring(F.md5(F.concat(_col(key).cast("string"), F.lit(str(seed)))), 1, 10)
