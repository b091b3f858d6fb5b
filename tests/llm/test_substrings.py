"""Removal of repeated word sequences against all windows compared by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import substrings
from tidemark.llm.substrings import Automaton, merged, remove_repeats

from .conftest import prose


def brute(rows, window=50):
    """Sorted (doc_id, n_words, spans, kept) of rows (doc_id, text)."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for a in range(len(w) - window + 1):
                if least[tuple(w[a : a + window])] < i:
                    gone[a : a + window] = [True] * window
        spans, a = [], None
        for k, g in enumerate([*gone, False]):
            if g and a is None:
                a = k
            elif not g and a is not None:
                spans.append((a, k))
                a = None
        out.append((i, len(w), spans, b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.stop) for s in r.removed], r.kept) for r in remove_repeats(df, **more).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_matching_statistics(references, query):
    a = Automaton()
    for r in references:
        a.add(r)
    parts = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max([k for k in range(1, e + 1) if tuple(query[e - k : e]) in parts], default=0) for e in range(1, len(query) + 1)]
    assert list(a.matches(query)) == want
    assert len(a.next) <= max(1, 2 * sum(map(len, references)))


def test_merged():
    import numpy as np

    assert merged(np.array([0, 1, 2, 5, 6, 9])) == [(0, 3), (5, 7), (9, 10)]
    assert merged(np.array([0, 4, 9]), 4) == [(0, 8), (9, 13)]
    assert merged(np.array([], int)) == []


def corpus(seed, n=60):
    """Texts over few words that copy passages of each other, short and long, and shared ones whose surroundings differ."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    common = [word() for _ in range(18)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            if out and rng.random() < 0.7:
                other = rng.choice(out)[1].split()
                a = rng.randrange(len(other) + 1)
                part = other[a : a + rng.randrange(5, 40)]
            else:
                part = common[: rng.randrange(8, 19)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        out.append((i * 3 % n if rng.random() < 0.9 else rng.randrange(n), " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:  # pieces of a few windows and many copies of a shard
        monkeypatch.setattr(substrings, "PIECE", 7)
        monkeypatch.setattr(substrings, "LONG", 40)
        monkeypatch.setattr(substrings, "DEALT", 2)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, window=12, gram=4) == brute(rows, 12)


def test_a_key_whose_owner_lacks_the_window_goes_to_the_second_round(spark):
    """Three texts share a gram, the last two a whole window that the first one lacks."""
    gram = [f"g{i}" for i in range(10)]
    text = lambda a, b: " ".join([f"{a}{i}" for i in range(30)] + gram + [f"{b}{i}" for i in range(30)])
    rows = [(1, text("a", "b")), (2, text("c", "d")), (3, text("c", "d")), (4, text("c", "e")), (5, text("f", "d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df, window=20)
    assert got == brute(rows, 20)
    assert [bool(g[2]) for g in got] == [False, False, True, True, True]


def test_a_window_of_exactly_fifty_words(spark):
    shared = [f"s{i}" for i in range(50)]
    rows = [(7, " ".join(["a", *shared, "b"])), (8, "\n".join(["c", *shared, "d"])), (9, " ".join(["e", *shared[1:], "f"])), (10, " ".join(x.upper() for x in shared))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert (8, 52, [(1, 51)], "c d") in got


def test_edges(edge, edge_rows):
    assert found(edge) == brute(edge_rows)


def test_repeated_ids_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LONG", 5_000)
    monkeypatch.setattr(substrings, "PIECE", 400)
    rng = random.Random(3)
    base = [f"v{rng.randrange(9999)}" for _ in range(5000)]
    long = " ".join(base)
    rows = [(5, long), (5, " ".join(base[100:200])), (4, " ".join(base[3000:3100])), (None, long), (9, long + " x"), (9, long + " x"), (2, " ".join(base[380:470]))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_passage_that_all_rows_share(spark):
    passage = prose(3, 70)
    rows = [(i, f"{prose(100 + i, 30)} {passage} {prose(500 + i, 30)}") for i in range(80)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0))) == brute(rows)


def test_empty_tables_and_ids_of_text(spark, empty):
    assert found(empty) == []
    with pytest.raises(TypeError, match="doc_id"):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
