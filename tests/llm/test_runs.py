"""Periodic runs against every stretch of every period, and the query against its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import queries, runs
from tidemark.llm.runs import best_run, collapsed, find_runs, long_ones, periodic_runs, stretches


def brute(w, repeats=4, least=6):
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        for s in range(n - q):
            if s and w[s - 1] == w[s - 1 + q]:
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size = e - s + q
            part = w[s : s + size]
            if size >= max(least, repeats * q) and all(part[p:] != part[:-p] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(90))]
    for _ in range(2):
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randrange(40)] = (unit * 40)[: rng.randint(1, 60)]
    return w


@pytest.mark.parametrize("sieved", [64, 0, 2])
def test_equals_brute_force(monkeypatch, sieved):
    monkeypatch.setattr(runs, "SIEVED", sieved)
    rng = random.Random(sieved)
    for _ in range(400):
        w = repetitive(rng)
        assert periodic_runs(w) == brute(w), w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=80), st.integers(1, 20))
def test_bits(bits, length):
    number = sum(1 << i for i, b in enumerate(bits) if b)
    have = long_ones(number, length)
    assert [have >> i & 1 for i in range(len(bits))] == [int(len(bits) - i >= length and all(bits[i : i + length])) for i in range(len(bits))]
    want, i = [], 0
    while i < len(bits):
        j = i
        while j < len(bits) and bits[j]:
            j += 1
        if j - i >= length:
            want.append((i, j))
        i = j + 1
    assert list(stretches(number, length)) == want


def test_one_word_over_and_over():
    assert periodic_runs(["x"] * 50_000) == [(0, 50_000, 1)]
    assert periodic_runs(["x"] * 5) == [] and periodic_runs(["x"] * 6) == [(0, 6, 1)]
    assert periodic_runs(list("abab") * 2) == [(0, 8, 2)] and periodic_runs(list("abababa")) == []


def test_best_run_compares_exactly():
    assert best_run([(0, 10, 2), (5, 5, 1), (9, 15, 3)]) == (0, 10, 2)
    assert best_run([(0, 3_000_000_001, 750_000_000), (1, 4, 1)]) == (0, 3_000_000_001, 750_000_000)
    assert best_run([]) is None


def test_edges(edge, edge_rows):
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in find_runs(edge).collect()), key=key)
    want = []
    for i, t in edge_rows:
        w = (t or "").encode().split()
        found = brute(w) if len(w) < 1000 else periodic_runs(w)
        want.append((i, len(w), found, best_run(found), b" ".join(collapsed(w, found)).decode()))
    assert got == sorted(want, key=key)


def test_empty_table(empty):
    assert find_runs(empty).count() == 0


def test_the_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, None if i == 40 else " \t".join(f"w{x}" for x in repetitive(rng))) for i in range(150)] + [(None, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_runs(spark, f"file://{tmp_path}").collect()}
    planted = 0
    for doc, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        drop = {i for s, k, q in found for i in range(s + q, s + k)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in drop))
    assert planted > 5
