"""Row filters with SQL three-valued logic: a NULL test result drops the row."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bodies that carry no text, titles of deleted posts, the
# moderation bot, the non-answer phrase, the unknown-version marker.
NO_TEXT = ("", "[removed]", "[deleted]")
NO_TEXT_DASHBOARD = ("[removed]", "")
GONE = ("[removed]", "[deleted]")
DELETED_TITLES = ("[deleted by user]", "[deleted]")
BOT_AUTHOR = "AutoModerator"
NON_ANSWER = "%therefore I cannot answer this question.%"
REMOVED_PREFIX = "[ Removed by Reddit ]%"
UNKNOWN_VERSION = "false"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(body) -> Column:
    """``body NOT IN ('', '[removed]', '[deleted]')``; a NULL body is dropped."""
    return ~_col(body).isin(*NO_TEXT)


def has_text_or_deleted(body) -> Column:
    """The shorter list of the author dashboard, which keeps ``[deleted]``."""
    return ~_col(body).isin(*NO_TEXT_DASHBOARD)


def has_text_by_hash(body) -> Column:
    """The same test on MD5 values, for tables that store the hash of the body."""
    return ~F.md5(_col(body)).isin(*[hashlib.md5(t.encode()).hexdigest() for t in NO_TEXT])


def not_profile_page(subreddit) -> Column:
    """``NOT LIKE 'u_%'``. The underscore is a wildcard: ``ukpol`` is dropped too."""
    return ~_col(subreddit).like("u_%")


def not_system_table(name) -> Column:
    return ~_col(name).like("pg_%")


def is_answer(analysis) -> Column:
    return ~_col(analysis).like(NON_ANSWER)


def not_removed_by_site(body) -> Column:
    return ~_col(body).like(REMOVED_PREFIX)


def known_version(version, also_not: tuple[str, ...] = ()) -> Column:
    return ~_col(version).isin(UNKNOWN_VERSION, *also_not)


def human_author(author) -> Column:
    """Named and not the moderation bot."""
    c = _col(author)
    return c.isNotNull() & (c != BOT_AUTHOR)


def survives_purge(author) -> Column:
    """What a ``DELETE … WHERE author = <bot>`` leaves: NULL authors stay."""
    c = _col(author)
    return c.isNull() | (c != BOT_AUTHOR)


def in_days(ts, start: str, end: str) -> Column:
    """Half-open range of days. The bounds sit on the raw column so the scan can prune."""
    c = _col(ts)
    return (c >= F.to_date(F.lit(start), "yyyy-MM-dd").cast("timestamp")) & (
        c < F.to_date(F.lit(end), "yyyy-MM-dd").cast("timestamp")
    )


def passes_language_gate(lang) -> Column:
    """English passes, and so does text whose language could not be told."""
    c = _col(lang)
    return (c == "en") | c.isNull()


def comment_route(body, author) -> Column:
    """Where a fetched comment goes: its own row and its post's, its own row, or nowhere."""
    b, a = _col(body), _col(author)
    return (
        F.when(b.isin(*GONE), "comment")
        .when(a.isNotNull() & (a != BOT_AUTHOR), "comment_and_post")
        .otherwise("none")
    )
