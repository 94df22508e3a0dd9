"""Phrases with gaps against a walk over the places of their words."""

import random

import pytest
from pyspark.sql import functions as F

from showloom.operators import grammar, search


def walked(places, most):
    """The word whose place is the first goes on until it would pass the next one; each such stop is a window. Places of
    several words that are alike come in the order of the phrase."""
    n = len(places)
    at = [sorted((p - k) * n + k for p in own) for k, own in enumerate(places)]
    if not all(at):
        return 0.0
    now, total = [0] * n, 0.0
    of = lambda w: at[w][now[w]]
    moves = lambda w: max(map(of, range(n))) // n - of(w) // n
    while True:
        w = min(range(n), key=of)
        behind = min(of(v) for v in range(n) if v != w)
        while now[w] + 1 < len(at[w]) and at[w][now[w] + 1] < behind:
            now[w] += 1
        if moves(w) <= most:
            total += 1 / (1 + moves(w))
        now[w] += 1
        if now[w] == len(at[w]):
            return total


@pytest.mark.parametrize("words, most", [(2, 1), (2, 4), (3, 2), (3, 6), (4, 9)])
def test_windows_equal_a_walk(spark, words, most):
    random.seed(words * 10 + most)
    rows = []
    for i in range(200):
        text = [random.randrange(words + 2) for _ in range(random.randrange(25))]
        rows.append((i, [[p for p, w in enumerate(text) if w == k] or None for k in range(words)]))
    df = spark.createDataFrame(rows, "i int, p array<array<int>>")
    got = {r["i"]: r["f"] for r in df.select("i", search.with_gaps([F.get("p", F.lit(k)) for k in range(words)], most).alias("f")).collect()}
    assert got == pytest.approx({i: walked([x or [] for x in p], most) for i, p in rows})
    assert sum(v > 0 for v in got.values()) > 20


def test_phrases_with_gaps_are_searched(spark):
    docs = spark.createDataFrame([(1, "red big house"), (2, "red house"), (3, "house red"), (4, "red a b c d house"), (5, "house")], "doc_id long, text string")
    index = search.FieldIndex.build(docs, ["text"])
    ids = lambda q: [r["doc_id"] for r in search.bm25(index, docs, q, 9).collect()]
    assert ids('"red house"') == [2] and ids('"red house"~1') == [2, 1] and set(ids('"red house"~2')) == {1, 2, 3} and set(ids('"red house"~4')) == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        ids('"red red"~2')
    (_, leaf), = grammar.parse('"a b"~3^2').clauses
    assert (leaf.kind, leaf.edits, leaf.boost) == ("phrase", 3, 2.0)
