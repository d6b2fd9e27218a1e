"""N-gram Jaccard join with set relations: blocks skipped by position, answers derived.

Sets are the distinct hashes of five-word shingles in one global order, frequent ones last.
Two sets that link share a shingle among the first ones of both, at places that leave
room for the overlap they need. The index lists of these shingles are cut into blocks
by set size. The place of a shingle in a set bounds the sizes of its partners, so that
only the blocks in this range are met.

Links are then found in rounds. The first checks each set against few others: the
leaders of its long lists and its best partner in short ones. Components follow. As long as
the pairs in different components are estimated to be more than the sets in them, a round
checks about as many of them as there are sets, and the components grow. The last round
meets all pairs that are still in different components, and first tries to answer a pair from
the overlaps of its two sets with a third, which bound its own overlap from both sides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.llm.common import all_columns, discard, free_name, lean, ship_package
from forumlake.llm.components import components
from forumlake.llm.words import hashed_words, shingles_of
from forumlake.session import durable

SHINGLE = 5
#: Links need a similarity of at least 3 / 4, in whole numbers: 100 * overlap >= 75 * union.
#: Of sets with n and m elements that is an overlap of 3 (n + m) / 7.
#: Shingles counted so often are frequent. At most MOST_FREQUENT, the most frequent ones,
#: go last (8 MB for a broadcast). The order decides how much is compared, not what is found.
FREQUENT = 32
MOST_FREQUENT = 1_000_000
#: Lists up to this length are met as a whole in the first round, longer ones by leaders.
SHORT_LIST = 32
#: Leaders of a long list, the first by a hash of the set alone, so that the lists of a group of
#: near copies have the same ones. More of them leave fewer sets of a large group for the second round.
LEADERS = 8
#: Bits of a set's sketch, which tells sets apart that differ too much. Sets of far more elements
#: fill it, and are then compared without its help.
SKETCH_BITS = 1024
#: Words of the bit map that tells which sets are compared (8 MB); false hits cost time only.
MAP_WORDS = 1 << 20
#: Rows with sets that a Python task hands over at once.
FRAME_ROWS = 1_000

# Bytes as they are counted: A to Z lower-cased, and one more so that none is zero.
_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], "uint64")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; empty without words.

    A to Z are lower-cased and words are parted by ASCII white space. Fewer words than a
    shingle has make one shingle of all.
    """
    coded = (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)
    for words, cuts in hashed_words(coded, _SPACE, _LOWER):
        whole = shingles_of(words, SHINGLE)
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            if last - first >= SHINGLE:
                yield np.unique(whole[first : last - SHINGLE + 1])
            else:
                yield shingles_of(words[first:last], SHINGLE)


def signature(shingles: np.ndarray) -> int:
    """One number for a set; equal sets have equal ones."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view("int64"))


def prefix_length(n: int) -> int:
    """So many of the first elements hold one that any linked set has too."""
    return n - (3 * n + 3) // 4 + 1


def counted_twice(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur twice or more, in order, and how often. Empties the list and sorts in
    place, so that all hashes are in memory once."""
    every = np.concatenate(sets)
    sets.clear()
    every.sort()
    again = every[1:] == every[:-1]
    # A hash begins where it equals the next one, but not the one before.
    edges = np.diff(np.concatenate([[False], again, [False]]).astype("int8"))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return every[first], (last - first + 1).astype("int32")


SET_COLUMNS = "doc_id long, n long, sig long, shingles array<long>, counts array<int>"


def document_sets(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n and sig (null for an empty set) of each row, stored; and the frequent shingles.

    Each task counts its own shingles and reports those it has met twice or more, so what
    is shuffled follows the repetitions in the corpus.
    """

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0

        def repeated() -> Iterator[pd.DataFrame]:
            found, n = counted_twice(waiting)
            for i in range(0, len(found), 100_000):
                own = slice(i, i + 100_000)
                yield pd.DataFrame({"doc_id": [None], "n": [None], "sig": [None],
                                    "shingles": [found[own]], "counts": [n[own]]})

        for batch in batches:
            sets = list(shingle_sets(batch["text"]))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n": [len(s) for s in sets],
                "sig": pd.array([signature(s) if len(s) else None for s in sets], "Int64"),
                "shingles": None, "counts": None})
            waiting.extend(sets)
            size += sum(map(len, sets))
            if size > 3_000_000:
                yield from repeated()
                size = 0
        if waiting:
            yield from repeated()

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = durable(texts.mapInPandas(read, SET_COLUMNS))
    counted = both.where("shingles IS NOT NULL").select(
        F.explode(F.arrays_zip("shingles", "counts")).alias("x")).select("x.shingles", "x.counts")
    frequent = durable(counted.groupBy("shingles").agg(F.sum("counts").alias("n")).where(F.col("n") >= FREQUENT))
    # Those above a count that keeps the list in its bound; no task sorts them all.
    least, listed = FREQUENT, 0
    for row in sorted(frequent.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        listed += row["rows"]
        if listed > MOST_FREQUENT:
            least = row["n"] + 1
            break
    last = np.sort(frequent.where(F.col("n") >= least).select("shingles").toPandas()["shingles"].to_numpy("int64"))
    documents = durable(both.where("n IS NOT NULL").select("doc_id", "n", "sig"))
    discard(both)
    discard(frequent)
    return documents, last


def prefixes(df: DataFrame, text_col: str, last: np.ndarray) -> DataFrame:
    """sig, n, the first shingles, rarest first, and the sketch of each set; once per set and task."""
    shared = df.sparkSession.sparkContext.broadcast(last)

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = shared.value, set()
        for batch in batches:
            rows = []
            for shingles in shingle_sets(batch["text"]):
                sig = signature(shingles) if len(shingles) else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                at = np.minimum(np.searchsorted(last, shingles), max(0, len(last) - 1))
                late = last[at] == shingles if len(last) else np.zeros(len(shingles), bool)
                ordered = np.concatenate([shingles[~late], shingles[late]])
                # A copy, which does not hold the whole set.
                rows.append((sig, len(shingles), ordered[: prefix_length(len(shingles))].copy(), sketch(shingles)))
                if len(rows) == FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=["sig", "n", "first", "sketch"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["sig", "n", "first", "sketch"])

    return df.select(F.col(text_col).alias("text")).mapInPandas(
        read, "sig long, n long, first array<long>, sketch array<long>")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits of which each shingle sets one, as longs. A bit that only one of two sets
    has stands for at least one element that only this set has."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[shingles >> 20 & SKETCH_BITS - 1] = True
    return np.packbits(bits).view("int64")


def whole_sets(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """sig, n and all shingles of the sets whose sig is in ``wanted`` (column sig), once each.

    The texts are hashed again, which is cheaper than to store all sets. A bit map of a fixed
    size tells the tasks which sets to send; sets that it lets through without need are
    dropped by the joins that follow.
    """
    words = bit_words(wanted, "sig").toPandas()
    table = np.zeros(MAP_WORDS, "int64")
    table[words["word"].to_numpy("int64")] = words["bits"].to_numpy("int64")
    shared = df.sparkSession.sparkContext.broadcast(table)

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = shared.value, set()
        for batch in batches:
            rows = []
            for shingles in shingle_sets(batch["text"]):
                sig = signature(shingles) if len(shingles) else None
                if sig is None or sig in seen:
                    continue
                bits = 1 << (sig & 63) | 1 << (sig >> 40 & 63)
                if int(table[sig >> 10 & MAP_WORDS - 1]) & bits & (1 << 64) - 1 == bits:
                    seen.add(sig)
                    rows.append((sig, len(shingles), shingles))
                    if len(rows) == FRAME_ROWS:
                        yield pd.DataFrame(rows, columns=["sig", "n", "shingles"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["sig", "n", "shingles"])

    found = df.select(F.col(text_col).alias("text")).mapInPandas(read, "sig long, n long, shingles array<long>")
    return found.dropDuplicates(["sig"])


def _word(key: str) -> Column:
    return F.expr(f"CAST(shiftright({key}, 10) & {MAP_WORDS - 1} AS INT)")


def _bits(key: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT)) | shiftleft(1L, CAST(shiftright({key}, 40) & 63 AS INT))")


def bit_words(keys: DataFrame, key: str) -> DataFrame:
    """A bit map of hashed keys, as its words that are not zero; at most MAP_WORDS rows."""
    return keys.select(_word(key).alias("word"), _bits(key).alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("bits"))


def likely_in(frame: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose key is in ``keys``, and a few others, without a shuffle."""
    marked = frame.withColumn("word", _word(key)).join(F.broadcast(bit_words(keys, key)), "word")
    return marked.where(F.col("bits").bitwiseAND(_bits(key)) == _bits(key)).select(*frame.columns)


def need(n: str, m: str) -> str:
    return f"CAST(ceil(3 * ({n} + {m}) / 7) AS BIGINT)"


def fits(a: str, b: str) -> str:
    """Whether a shingle at both places leaves room for the overlap that the sizes need."""
    return (f"{a}.pos <= {a}.n - {need(f'{a}.n', f'{b}.n')} AND {b}.pos <= {b}.n - {need(f'{a}.n', f'{b}.n')}")


def can_differ(a: str, b: str) -> str:
    """Whether the sketch of a lacks no more of b's bits than the needed overlap leaves."""
    only = f"zip_with({a}.sketch, {b}.sketch, (p, q) -> CAST(bit_count(p & ~q) AS BIGINT))"
    return f"aggregate({only}, 0L, (s, v) -> s + v) <= {a}.n - {need(f'{a}.n', f'{b}.n')}"


def band(n: str) -> str:
    return f"CAST(floor(ln({n}) / ln(4 / 3D)) AS INT)"


def index_lists(first: DataFrame) -> DataFrame:
    """The entries of all lists with at least two sets, stored: shingle, sig, n, pos, length."""
    entries = first.select("sig", "n", F.posexplode("first").alias("pos", "shingle"))
    # Counted by 40 of their bits, which are shorter in the shuffle. Two shingles that share them
    # are counted as one, so that no list is missed; all entries of a list have the same length.
    start = F.expr("shiftrightunsigned(shingle, 24)")
    counts = durable(entries.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("length")).where("length > 1"))
    # Most shingles stand in one set only: a bit map of a fixed size keeps them from the shuffle.
    marked = entries.withColumn("mark", F.xxhash64(start))
    few = likely_in(marked, "mark", counts.select(F.xxhash64("start").alias("mark"))).drop("mark")
    lists = few.join(counts, start == F.col("start")).groupBy("start", "shingle", "sig").agg(
        F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("length").alias("length")).drop("start")
    lists = durable(lists)
    discard(counts)
    return lists


def met_as_whole(entries: DataFrame) -> DataFrame:
    """Pairs (a < b) of sets that share a short list and fit, once for each list they share.

    Both sides are the same rows by the same key, which are shuffled once.
    """
    own = entries.select("shingle", "sig", "n", "pos")
    joined = own.alias("x").join(own.alias("y"), F.expr(
        f"x.shingle = y.shingle AND x.sig < y.sig AND {fits('x', 'y')}"))
    return joined.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))


def leaders_of(entries: DataFrame, draw: int = 0) -> DataFrame:
    """The LEADERS entries of each list that come first by a hash of their set; other ones by ``draw``."""
    drawn = F.xxhash64("sig", F.lit(draw)) if draw else F.xxhash64("sig")
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("shingle").orderBy(drawn, "sig")))
    return ranked.where(F.col("rank") <= LEADERS).drop("rank", "length")


def met_by_blocks(entries: DataFrame, more: str = "TRUE", some: str | None = None) -> DataFrame:
    """Pairs (a < b) of sets that share a list and fit, once for each list they share.

    An entry meets the blocks of its list from three quarters of its size to the largest
    size that its place allows. With ``some`` only the entries that it names stand in blocks; a pair
    of two of them is then given twice.
    """
    most = "CAST(floor((4 * n - 7 * pos) / 3) AS BIGINT)"
    low = f"greatest(0, {band('greatest(1, floor(3 * n / 4))')})"
    able = entries.where(f"{most} >= 1 AND 4 * {most} >= 3 * n")
    probes = able.withColumn("block", F.explode(F.expr(f"sequence({low}, {band(most)})"))).alias("x")
    blocks = entries.where(some or "TRUE").withColumn("block", F.expr(band("n"))).alias("y")
    order = "x.sig <> y.sig" if some else "x.sig < y.sig"
    joined = probes.join(blocks, F.expr(
        f"x.shingle = y.shingle AND x.block = y.block AND {order} AND {fits('x', 'y')} AND {more}"))
    return joined.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))


def both_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs a, b with the sizes n, m and the number of elements that both columns have."""
    left = sets.select(F.col("sig").alias("a"), "n", F.col(column).alias("s"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col(column).alias("t"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "n", "m", F.size(F.array_intersect("s", "t")).cast("long").alias("overlap"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))


def alike_by_sketch(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs that the sketches of their sets do not rule out, stored."""
    pairs = durable(pairs.select("a", "b"))  # read twice below
    few = likely_in(first.select("sig", "n", "sketch"), "sig", ends_of(pairs)).dropDuplicates(["sig"])
    both = pairs.join(few.select(F.col("sig").alias("a"), F.struct("n", "sketch").alias("x")), "a").join(
        few.select(F.col("sig").alias("b"), F.struct("n", "sketch").alias("y")), "b")
    kept = durable(both.where(f"{can_differ('x', 'y')} AND {can_differ('y', 'x')}").select("a", "b"))
    discard(pairs)
    return kept


def possible(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs that may link, stored, with n, m and the overlap of their first elements.

    The last of the first elements of one set comes before that of the other. What both
    have up to there is counted; behind it the set has too few elements for more.
    """
    pairs = durable(pairs.select("a", "b"))  # read three times below
    few = likely_in(first, "sig", ends_of(pairs)).dropDuplicates(["sig"])
    counted = both_sets(pairs, few, "first")
    behind = "greatest(CAST(floor((3 * n + 3) / 4) AS BIGINT), CAST(floor((3 * m + 3) / 4) AS BIGINT)) - 1"
    kept = durable(counted.where(f"overlap + {behind} >= {need('n', 'm')}"))
    discard(pairs)
    return kept


def overlaps(df: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """The pairs with the sizes n, m and the exact overlap of their sets, stored."""
    pairs = pairs.select("a", "b")
    return durable(both_sets(pairs, whole_sets(df, text_col, ends_of(pairs)), "shingles"))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("100 * overlap >= 75 * (n + m - overlap)").select("a", "b")


def answered(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) with the bounds that known overlaps with a third set give.

    The third set is the one most similar to a, or to b, among those that it was checked
    against; so each pair is looked up twice, however many known overlaps a set has.
    If z shares x with a and y with b, a and b share at least x + y - |z| of z, and at most
    the smaller of x and y, and outside of z the smaller of what a and b have left.
    """
    facts = known.select("a", F.col("b").alias("z"), F.col("m").alias("size"), "n", F.col("overlap").alias("x")).union(
        known.select("b", "a", "n", "m", "overlap"))
    alike = (F.col("x") / (F.col("n") + F.col("size") - F.col("x"))).alias("alike")
    nearest = facts.groupBy("a").agg(F.max(F.struct(alike, "z", "size", "x")).alias("third")).select("a", "third.*")
    others = facts.select(F.col("a").alias("b"), "z", F.col("x").alias("y"))

    def bounds(pairs: DataFrame) -> DataFrame:
        return pairs.join(nearest, "a").join(others, ["b", "z"]).select(
            "a", "b", F.expr("x + y - size").alias("least"),
            F.expr("least(x, y) + least(n - x, m - y)").alias("most"))

    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("n").alias("m"))
    both = bounds(pairs).union(bounds(turned).select("b", "a", "least", "most"))
    found = both.groupBy("a", "b").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    return pairs.join(found, ["a", "b"], "left")


def with_root(frame: DataFrame, key: str, name: str, roots: DataFrame) -> DataFrame:
    """``frame`` with the root of the set ``key`` as column ``name``; a set without links is its own."""
    own = roots.select(F.col("node").alias(key), F.col("root").alias(name))
    return frame.join(own, key, "left").withColumn(name, F.coalesce(name, key))


def open_lists(lists: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of the lists with sets of more than one component, stored, with the roots and sketches
    of their sets.

    A set has its root found once, not with each entry, and its sketch is shuffled once.
    """
    entries = lists.select("shingle", "sig", "n", "pos", "length")
    rooted = durable(entries.join(with_root(sketches, "sig", "root", roots), "sig"))
    open_ = rooted.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r <> q")
    # A list of one component that gets through has no two roots and so gives no pair.
    entries = durable(likely_in(rooted, "shingle", open_))
    discard(rooted)
    return entries


def pairs_left(entries: DataFrame, more: str, draw: int) -> tuple[float, int]:
    """About how many pairs the lists give, each as often as they share one, and how many sets are in them.

    The pairs of a few entries of each list stand for those of all.
    """
    drawn = leaders_of(entries, draw)
    met = entries.alias("x").join(drawn.alias("y"), F.expr(
        f"x.shingle = y.shingle AND x.sig <> y.sig AND {fits('x', 'y')} AND {more}"))
    # Each pair is met from either side, with the chance that a side is drawn.
    pairs = met.agg(F.sum(F.col("x.length") / F.lit(2.0 * LEADERS))).first()[0] or 0.0
    return pairs, entries.agg(F.approx_count_distinct("sig")).first()[0]


def links_of(df: DataFrame, text_col: str, last: np.ndarray) -> DataFrame:
    """Links (a, b) between sets that connect every two sets that a chain of links connects.

    All links between sets in different components of the first round are met, so the
    components of the result are those of all links.
    """
    every = durable(prefixes(df, text_col, last))
    lists = index_lists(every)
    # Most sets stand in no list: nothing of theirs is asked for again.
    first = durable(likely_in(every, "sig", lists.select("sig").distinct()))
    discard(every)
    short = lists.where(F.col("length") <= SHORT_LIST)
    sketches = first.select("sig", "sketch").dropDuplicates(["sig"])
    long_ = durable(lists.where(F.col("length") > SHORT_LIST).join(sketches, "sig"))
    alike = f"{can_differ('x', 'y')} AND {can_differ('y', 'x')}"

    # Sketches first: they are far shorter than the first elements, and leave few pairs.
    near = alike_by_sketch(met_as_whole(short).distinct(), first)
    close = possible(near, first)
    either = close.select("a", "b", "overlap").union(close.select("b", "a", "overlap"))
    best = either.groupBy("a").agg(F.max(F.struct("overlap", "b")).alias("best")).select(
        F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
    # From here on only sets in long lists are asked for their first elements and sketches.
    listed = durable(likely_in(first, "sig", long_.select("sig").distinct()))
    sketches = listed.select("sig", "sketch").dropDuplicates(["sig"])
    for stage in (near, first, lists):
        discard(stage)

    # Their sketches come after the choice, which shuffles the entries.
    leaders = durable(leaders_of(long_.drop("sketch")).join(sketches, "sig"))
    led = long_.alias("x").join(leaders.alias("y"), F.expr(
        f"x.shingle = y.shingle AND x.sig <> y.sig AND {fits('x', 'y')} AND {alike}")).select(
        F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    # The sketches leave few that their first elements could still rule out.
    met = durable(best.union(led).distinct())
    known = overlaps(df, text_col, met)  # of all pairs met
    discard(leaders)
    discard(met)
    roots = durable(components(linked(known)))
    entries = open_lists(long_, sketches, roots)
    alike = f"x.root <> y.root AND {alike}"
    before = float("inf")
    for draw in count(1):
        left, sets = pairs_left(entries, alike, draw)
        # A share of the pairs is worth checking while that joins components.
        if left <= sets or left > before / 2:
            break
        before = left
        some = f"pmod(xxhash64(sig, {draw}), 1000000) < {1_000_000 * sets / (2 * left)}"
        drawn = met_by_blocks(entries, alike, some).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        maybe = possible(drawn, listed)
        found = overlaps(df, text_col, maybe)
        discard(maybe)
        known = known.union(found)
        if linked(found).isEmpty():
            break
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked(found))
        grown = durable(components(edges))
        discard(roots)
        discard(entries)
        roots, entries = grown, open_lists(long_, sketches, grown)

    apart = with_root(with_root(close, "a", "r", roots), "b", "q", roots).where("r <> q").select("a", "b", "n", "m")
    apart = durable(apart.join(known.select("a", "b"), ["a", "b"], "left_anti"))
    far = met_by_blocks(entries, alike).distinct()
    asked = known.select("a", "b").union(apart.select("a", "b"))
    beyond = possible(far.join(asked, ["a", "b"], "left_anti"), listed)
    rest = durable(apart.union(beyond.select("a", "b", "n", "m")))
    for stage in (listed, long_, entries, close, roots, apart, beyond):
        discard(stage)
    derived = durable(answered(rest, known))
    discard(rest)
    wanted = need("n", "m")
    by_bound = derived.where(f"least >= {wanted}").select("a", "b")
    unclear = derived.where(f"coalesce(least < {wanted} AND most >= {wanted}, TRUE)")
    checked = overlaps(df, text_col, unclear)
    links = durable(linked(known).union(by_bound).union(linked(checked)))
    for stage in (known, derived, checked):
        discard(stage)
    return links


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and sig and root, numbers of its
    set and of its component.

    The component is named by the smallest id that can be reached by links, its own included;
    null ids count only where there is no other. Equal sets are one. A null text or one
    without words has no shingles and stands alone. Repeated rows each get a row; an
    empty table gives none; columns other than the two named are not read.
    """
    ship_package(df.sparkSession)
    documents, last = document_sets(df, id_col, text_col)
    alone = documents.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sig",
        F.col("sig").alias("root"))
    links = links_of(df, text_col, last)
    roots = durable(components(links))
    discard(links)
    sets = documents.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    sets = durable(sets.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn(
        "root", F.coalesce("root", "sig")))
    names = durable(sets.groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(sets.join(names, "root").select("sig", "component_id", "root"))
    together = documents.where("n > 0").join(named, "sig").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "sig", "root")
    return together.union(alone)


def set_number(text: Column) -> Column:
    """The ``sig`` of a text's set; null for an empty one.

    Declared nondeterministic, so that Spark asks for it once a row: a copy of it in a filter would
    hash the texts twice, in a second Python worker of the same task.
    """

    @F.pandas_udf("long")
    @lean
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sets = shingle_sets(batch)
            yield pd.Series(pd.array([signature(s) if len(s) else None for s in sets], "Int64"))

    return number.asNondeterministic()(text)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies, with all columns: one of each component stays.

    It is the row with the component's name as its id, or, where all ids are null, one of
    them. Rows without words all stay.
    """
    groups = near_duplicate_groups(df, id_col, text_col)
    sig, key, word, bits, likely, copy = (free_name(df.columns, n) for n in (
        "set_number", "set_key", "set_word", "set_bits", "set_likely", "set_held"))

    def keyed(i: Column, s: Column) -> Column:
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), s.cast("string"))

    # Most rows stand alone. A bit map of those that do not keeps their texts from the shuffle.
    groups = durable(groups)
    one = groups.where("sig IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sig")).alias("one"),
        F.count(F.lit(1)).alias("rows"))
    several = durable(one.where("rows > 1"))
    stay = several.select(keyed(F.col("one.doc_id"), F.col("one.sig")).alias(key))
    held = durable(groups.join(several.select("root"), "root", "left_semi").select(F.col("sig").alias(sig)).distinct())
    words = bit_words(held, sig).select(F.col("word").alias(word), F.col("bits").alias(bits))
    rows = df.withColumn(sig, set_number(F.col(text_col))).withColumn(word, _word(sig))
    rows = rows.join(F.broadcast(words), word, "left").withColumn(
        likely, F.coalesce(F.col(bits).bitwiseAND(_bits(sig)) == _bits(sig), F.lit(False)))
    alone = rows.where(~F.col(likely)).select(*all_columns(df))
    rows = rows.where(likely).withColumn(key, keyed(F.col(id_col).cast("long"), F.col(sig)))
    rows = rows.join(held.withColumn(word, F.lit(1)).select(F.col(sig), F.col(word).alias(copy)), sig, "left")
    false_hits = rows.where(F.col(copy).isNull()).select(*all_columns(df))
    together = rows.where(F.col(copy).isNotNull()).join(stay, key, "left_semi").dropDuplicates([key])
    return alone.union(false_hits).union(together.select(*all_columns(df)))
