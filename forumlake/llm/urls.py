"""URL filter: rules by host and path, then a blocked Bloom filter and an exact join.

Every step is a DataFrame expression. The filter is a table of 256-bit blocks. A key
picks one block and sets two bits in each of its four words, so a probe reads one row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import ascii_lower
from forumlake.session import durable

#: Bits of the filter for each listed URL, and the most blocks it may have. The most blocks
#: (2^17 rows of 5 longs, about 8 MB) bound what is broadcast; a longer list fills the
#: filter more, so that more rows reach the exact join, with the same result.
BITS_PER_KEY = 20
MOST_BLOCKS = 1 << 17
WORDS = 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page: no scheme, query, fragment, ``www.`` or ``m.``, ``.html`` or
    slashes at the end. Null without a host, so such a URL is never listed."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(path, r"(\.html|/+)$", "")))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, both null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def compile_list(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct canonical URLs of a list, stored, in a column ``listed``."""
    parts = urls.select(url_host(F.col(url_col)).alias("h"), url_path(F.col(url_col)).alias("p"))
    listed = parts.select(canonical(F.col("h"), F.col("p")).alias("listed"))
    return durable(listed.where("listed IS NOT NULL").distinct())


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(n_blocks))


def _masks(key: str) -> list[Column]:
    bits = f"xxhash64({key}, 1)"
    at = [f"CAST(shiftright({bits}, {6 * i}) & 63 AS INT)" for i in range(2 * WORDS)]
    return [F.expr(f"shiftleft(1L, {at[i]}) | shiftleft(1L, {at[i + WORDS]})") for i in range(WORDS)]


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """Blocks ``b``, ``w0`` … ``w3`` of the listed keys, and how many blocks there can be."""
    n_blocks = 1
    while n_blocks < MOST_BLOCKS and n_blocks * 64 * WORDS < listed.count() * BITS_PER_KEY:
        n_blocks *= 2
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks("listed"))]
    keys = listed.select(_block(F.col("listed"), n_blocks).alias("b"), *masks)
    words = [F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy("b").agg(*words), n_blocks


def url_verdicts(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Each page with host, path, the rule that decides, and ``allow`` or ``block``.

    ``listed`` comes from :func:`compile_list`. Without a fitting rule a page is blocked if
    its canonical URL is listed, else allowed. One row per input row: repeated rows and
    repeated URLs each get their own. A null URL or one without ``://`` has an empty host
    and path and is allowed; an empty table gives none; other columns are not read.
    """
    url = F.col(url_col)
    found = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"),
                         url_path(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, verdict = matching_rule(host, path, rules)
    found = found.select("*", rule.alias("rule"), verdict.alias("verdict"),
                         canonical(host, path).alias("key"))
    blocks, n_blocks = bloom_filter(listed)
    probed = found.withColumn("b", F.when(F.col("rule").isNull(), _block(F.col("key"), n_blocks)))
    probed = probed.join(F.broadcast(blocks), "b", "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks("key")):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("possible", F.col("key").isNotNull() & F.coalesce(hit, F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    settled = probed.where(~F.col("possible")).select(
        *columns[:4], F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    checked = probed.where("possible").join(listed, F.col("key") == F.col("listed"), "left")
    return settled.union(checked.select(
        *columns[:4],
        F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")))
