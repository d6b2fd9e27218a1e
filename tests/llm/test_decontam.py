"""Benchmark items of all lengths and scripts."""

import numpy as np
import pytest

from forumlake.llm import decontam


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


FILLER = " ".join(words("f", 700))


def found(text, *items):
    index = decontam.build_index(list(enumerate(items)))
    return [[h["item_id"] for h in hits] for hits in decontam.search([text, FILLER, None], index)]


@pytest.mark.parametrize("item", ["blue heron", "Zugzwang", "one two three four", "\u957f\u6c5f\u662f\u4e2d\u56fd\u6700\u957f\u7684\u6cb3\u6d41\u5417",
                                  "\u6771\u4eac\u306e\u5929\u6c17\u306f\uff1f\u6674\u308c\u3067\u3059\u3002",
                                  "\u0e41\u0e21\u0e48\u0e19\u0e49\u0e33\u0e22\u0e32\u0e27"])
def test_short_and_unsegmented_items(item):
    assert found(f"{FILLER} {item.upper()} {FILLER}", item) == [[0], [], []]
    glued = f"\u6211\u5011{item}\u6211\u5011" if not item.isascii() else f"{FILLER} {item}, {FILLER}"
    assert found(glued, item) == [[0], [], []]
    assert found(f"{FILLER} {' '.join(reversed(item.split()))[::-1]}", item) == [[], [], []]


@pytest.mark.parametrize("first, last", [(128, 428), (100, 360), (0, 260), (701, 999), (333, 600)])
def test_verbatim_passage_of_a_long_item(first, last):
    item = words("w", 1000)
    assert found(f"{FILLER} {' '.join(item[first:last])} {FILLER}", " ".join(item)) == [[0], [], []]


@pytest.mark.parametrize("n", [200, 256, 257, 300, 900])
def test_half_of_question_and_answer_at_any_length(n):
    question, answer = words("q", n - 60), words("a", 60)
    item = " ".join(question) + ". " + " ".join(answer) + "."
    half = " ".join(question[(n - 60) * 2 // 5:]) + " " + " ".join(answer[:40])
    assert found(f"{FILLER} {half} {FILLER}", item) == [[0], [], []]
    hits = decontam.search([item], decontam.build_index([(0, item)]))[0]
    assert [(h["question"], h["answer"]) for h in hits] == [(1.0, 1.0)]


def test_scattered_words_of_a_long_item_are_no_leak():
    rng = np.random.default_rng(1)
    item = words("w", 600)
    assert found(" ".join(rng.permutation(item)), " ".join(item)) == [[], [], []]


def test_parts_give_what_one_index_gives(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vocabulary = words("v", 120)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(3, 40))) + ". " + " ".join(rng.choice(vocabulary, 6)) for _ in range(60)]
    texts.append(" ".join(words("w", 600)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (70, None), (3, texts[3]), (4, texts[5])]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = []
    for i, t in enumerate(texts):
        own = t.split()
        docs.append((i, " ".join([*rng.choice(vocabulary, 90), *own[len(own) // 5:], *rng.choice(vocabulary, 90)]), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, texts[1], "x"), (2, docs[2][1], "x"), (102, FILLER, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, more string")

    def results():
        leaks = [(r["doc_id"], r["item_id"], round(r["score"], 9), r["question"], r["answer"])
                 for r in decontam.find_leaks(df, items).collect()]
        return sorted(leaks, key=repr), sorted(map(tuple, decontam.drop_leaks(df, items).collect()), key=repr)

    one = results()
    monkeypatch.setattr(decontam, "INDEX_BYTES", 2_000)
    assert decontam.parts_of(items, "item_id", "text")[1] > 3
    assert results() == one
    assert len(one[0]) > 20 and 3 <= len(one[1]) < len(docs)
