"""Periodic runs of words: rare words split a text until none is left, then lags are scanned.

A run is a stretch of words with a smallest period q, at least EXPONENT periods and SHORTEST
words long, that no neighbouring word extends. Each of its words occurs EXPONENT times in it,
so a word that is rarer in its segment stands in no run there and splits the segment. Splits
make other words rare. What is left at the end is short, or repeats itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import ship_package

SHORTEST = 6
EXPONENT = 4


def segments(words: Sequence[bytes]) -> list[tuple[int, int]]:
    """The stretches (from, to) that hold all runs, in which every word occurs often enough.

    A split counts the smaller parts anew and takes their words off the counts of the largest,
    so a word is counted again at most as often as its segment can be halved.
    """
    found: list[tuple[int, int]] = []
    counts = Counter(words)
    rare = {w for w, n in counts.items() if n < EXPONENT}
    places: dict[bytes, list[int]] = {}
    cuts = [i for i, w in enumerate(words) if w in rare]
    waiting = [(0, len(words), counts, cuts)]
    while waiting:
        low, high, counts, cuts = waiting.pop()
        if not cuts:
            found.append((low, high))
            continue
        edges = [low - 1, *cuts, high]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a > SHORTEST]
        if not parts:
            continue
        if not places:
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
        largest = max(parts, key=lambda p: p[1] - p[0])
        for part in parts:
            if part != largest or 2 * (part[1] - part[0]) < high - low:
                own = Counter(words[part[0] : part[1]])
                changed = own
            else:
                changed = Counter(words[low : part[0]])
                changed.update(words[part[1] : high])
                own = counts
                own.subtract(changed)
            rare = [w for w in changed if 0 < own[w] < EXPONENT]
            waiting.append((*part, own, sorted(i for w in rare for i in _between(places[w], *part))))
    return sorted(found)


def _between(places: list[int], low: int, high: int) -> list[int]:
    at = np.searchsorted(places, [low, high])
    return places[at[0] : at[1]]


def _same_until(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from ``at`` on, going by ``step``, whose word differs from the one ``lag``
    further; or where the segment ends."""
    end = len(ids) - lag if step > 0 else -1
    width = 64
    while at != end:
        if step > 0:
            to = min(end, at + width)
            differ = ids[at:to] != ids[at + lag : to + lag]
        else:
            to = max(end, at - width)
            differ = (ids[to + 1 : at + 1] != ids[to + 1 + lag : at + 1 + lag])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at + step * first
        at, width = to, 2 * width
    return end


def lag_scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment.

    A run of period q covers EXPONENT multiples of q, all with one word. Only where the words
    at these places agree are neighbours compared; together the probes of all lags look at
    n log n words. An interval that a smaller period has is the same run.
    """
    runs: dict[tuple[int, int], int] = {}
    for lag in range(1, len(ids) // EXPONENT + 1):
        probes = ids[::lag]
        same = probes[1:] == probes[:-1]
        for _ in range(EXPONENT - 2):
            same = same[1:] & same[:-1] if len(same) > 1 else same[:0]
        hits = np.flatnonzero(same) * lag
        for start, end in [k for k, q in runs.items() if lag % q == 0] if len(hits) else ():
            hits = hits[(hits < start) | (hits + (EXPONENT - 1) * lag >= end)]
        done = 0
        for hit in hits.tolist():
            if hit < done:
                continue
            done = _same_until(ids, hit, lag, 1)
            start = _same_until(ids, hit, lag, -1) + 1
            end = done + lag
            if done > hit and end - start >= max(SHORTEST, EXPONENT * lag):
                runs.setdefault((start, end), lag)
    return [(start, end - start, lag) for (start, end), lag in runs.items()]


def periodic_runs(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start and then period."""
    runs = []
    for low, high in segments(words):
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words[low:high]], "int32")
        runs += [(low + start, length, lag) for start, length, lag in lag_scan(ids)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats behind its first period."""
    if not runs:
        return list(words)
    step = np.zeros(len(words) + 1, "int64")
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    again = np.cumsum(step)
    return [w for w, n in zip(words, again.tolist()) if not n]


RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the runs of the text in order, and the text with each run cut to one period.

    Words are parted by ASCII white space and numbered from 0; the kept ones are joined by
    one space. A null or empty text has no words, no runs and an empty rest. Each row is
    read on its own and as a whole, so repeated rows and null ids give a row each; an
    empty table gives none. Columns other than the two named are not read.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf(RUNS)
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = text.encode("utf-8", "surrogatepass").split()
                runs = periodic_runs(words)
                rest = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
                rows.append(([dict(zip(("start", "length", "period"), r)) for r in runs], rest))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.select("doc_id", read("text").alias("found")).select("doc_id", "found.*")
