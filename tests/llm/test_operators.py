"""Each operator against a brute-force version, and its defined results for odd rows."""

import functools
import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tidemark.llm import jaccard, licenses, materialise, packing, ppm, simhash, sketches, tiling, toxicity, urls, warc

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


# --- op1


def fingerprint(t):
    w = words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_edges(edge, edge_rows, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows)
    want = {i: fingerprint(t) for i, t in edge_rows if i and len(t or "") < 100_000}
    for r in got:
        if r.doc_id in want:
            assert int(r.fingerprint, 16) == want[r.doc_id]
    comp = {r.doc_id: r.component_id for r in got if r.doc_id}
    near = [(a, b) for a in want for b in want if (want[a] ^ want[b]).bit_count() <= 2]
    expected = components(near, want)
    assert {i: comp[i] for i in want} == expected
    assert comp[1] == comp[2] == comp[3] == 1
    assert simhash.near_duplicates(empty).collect() == []


def test_links_of_dense_groups_lose_no_component(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for b in base[:4]:
        for _ in range(400):
            f = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(fps | {int(b) for b in base})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(fps)], "fp long, rep long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    arr = np.array(fps, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)]
    want = components(pairs, range(len(fps)))
    assert {i: found.get(i, i) for i in range(len(fps))} == want


@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_plan_covers_every_pair_within_the_distance(n):
    masks = simhash.plan(n, np.full(64, 0.5), np.eye(64), 2)
    rng = np.random.default_rng(n % 97)
    for _ in range(300):
        bits = rng.choice(64, 2, replace=False)
        differ = sum(1 << int(b) for b in bits)
        assert any(m & differ == 0 for m in masks)


def test_thresholds_are_unequal_where_parts_cost_differently():
    cost, chosen = simhash.allocate([[0, 1, 5], [0, 100, 900], [0, 1, 5]], 0)
    assert sum(chosen) == 0
    assert chosen[1] == -1
    assert cost == 6


def test_deduplicate_keeps_one_of_each_group(edge):
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and 6 not in ids and 12 not in {k for k in ids if k == 6}
    assert ids[None] == 1 and ids[1] == 1 and 2 not in ids and 3 not in ids and ids[7] == 1 and 8 not in ids


# --- op2


def test_ppm_against_a_plain_trie(edge, edge_rows, empty):
    order, held = 3, {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in edge_rows if i}
    held[None] = True
    toks = [(i, words(t) + [None]) for i, t in edge_rows]
    c = Counter(w for i, ws in toks if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    trie = defaultdict(Counter)

    def line(ws):
        return bytes([255]) * order + b"".join(w.encode() + b" " for w in ws[:-1]) + b"\xff"

    for i, ws in toks:
        if not held[i]:
            q = line(ws)
            for p in range(order, len(q)):
                for k in range(order + 1):
                    trie[q[p - k : p]][q[p]] += 1

    def log10(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            node = trie.get(context[order - k :])
            if not node:
                continue
            rest = {s: m for s, m in node.items() if s not in excluded}
            if symbol in rest:
                return out + math.log10(rest[symbol] / (sum(rest.values()) + len(rest)))
            if rest:
                out += math.log10(len(rest) / (sum(rest.values()) + len(rest)))
            excluded |= set(node)
        return out - math.log10(256 - len(excluded))

    for head in (1 << 19, 40):
        got = ppm.score(edge, order=order, head=head).collect()
        assert len(got) == len(edge_rows)
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, ws in toks:
            for r in by[i]:
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
                assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
                if len(ws) < 200 and i != 10:
                    q = line(ws)
                    assert r.score == pytest.approx(sum(log10(q[p - order : p], q[p]) for p in range(order, len(q))), rel=1e-9)
    assert ppm.score(empty).collect() == []


def test_ppm_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(list(b"abc d"), 400).tolist())
    g = np.array([text[i] | text[i - 1] << 8 | text[i - 2] << 16 for i in range(2, 400)], dtype=np.uint64)
    u, n = np.unique(g, return_counts=True)
    levels = [ppm.Level.shorter(u, n, k) for k in range(3)]
    for context in (b"ab", b"zz", b"za"):
        q = np.array([s | context[1] << 8 | context[0] << 16 for s in range(256)], dtype=np.uint64)
        assert (10 ** ppm.log_probabilities(q, levels)).sum() == pytest.approx(1.0)


# --- op3


def test_sketches_edges(edge, edge_rows, empty):
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = sketches.next_likeness(edge).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        if i != 6:
            assert (by[i].n_chars, by[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= by[i].near_edited <= 1
    same = [r for r in got if r.doc_id == 6]
    assert same[0].fingerprint == same[1].fingerprint == by[5].fingerprint
    assert by[6].near_next == 1.0 and by[2].near_next == 1.0
    assert sketches.next_likeness(empty).collect() == []


def test_containment_of_unequal_documents_and_merges(spark):
    whole, part = prose(3, 20_000), prose(3, 4000)
    a, b = sketches.sketches([whole, part])
    true = len(set(zip(*[words(part)[i:] for i in range(5)])) & set(zip(*[words(whole)[i:] for i in range(5)]))) / len(set(zip(*[words(part)[i:] for i in range(5)])))
    assert sketches.likeness(a, b)[0] == pytest.approx(true, abs=0.1)
    df = spark.createDataFrame([(1, prose(1, 300)), (1, prose(2, 300))], "doc_id long, text string")
    merged = sketches.merge(sketches.sketch(df), "doc_id").first().hashes
    parts = [set(r.hashes) for r in sketches.sketch(df).collect()]
    assert set(merged) == parts[0] | parts[1]


# --- op4


def test_leaks_are_found_in_any_order_and_clean_rows_stay(spark, edge, empty):
    item = prose(99, 40)
    w = item.split()
    turned = " ".join(w[20:] + ["zzz"] + w[:20])
    half = " ".join(w[:20])
    docs = spark.createDataFrame([(1, f"{prose(1, 50)} {item.upper()}. {prose(2, 50)}"), (2, turned), (3, half), (4, prose(4, 100)), (5, None), (6, item), (6, item), (7, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short one")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.tiles) for r in tiling.leaks(docs, bench).collect())
    assert got == [(1, 10, 1), (2, 10, 2), (6, 10, 1), (6, 10, 1)]
    assert got == sorted((r.doc_id, r.item_id, r.tiles) for r in tiling.leaks(docs, bench, block_bytes=64).collect())
    assert sorted(r.doc_id for r in tiling.decontaminate(docs, bench).collect()) == [3, 4, 5, 7]
    assert tiling.decontaminate(edge, bench).count() == edge.count()
    assert tiling.decontaminate(edge, bench).columns == edge.columns
    assert tiling.leaks(empty, bench).collect() == []
    assert tiling.leaks(docs, bench.where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=2, max_size=12), st.lists(st.integers(1, 5), max_size=25))
def test_tiles_equal_greedy_search(a, b):
    def greedy(shortest):
        fa, fb, out = [True] * len(a), [True] * len(b), []
        while True:
            best = None
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                        k += 1
                    if k >= shortest and (best is None or k > best[0]):
                        best = (k, i, j)
            if best is None:
                return out
            out.append(best)
            for k in range(best[0]):
                fa[best[1] + k] = fb[best[2] + k] = False

    got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 2)
    want = greedy(2)
    assert sorted((t[0] for t in got), reverse=True)[:1] == [t[0] for t in want][:1]
    assert sum(t[0] for t in got) == pytest.approx(sum(t[0] for t in want), abs=2)


# --- op5


def test_licenses_edges(edge, edge_rows, spark, empty):
    texts = ["CC-BY cc by; (cc)\nBY all rights reserved", "GNU General Public License", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH x\nx", "ccbyé cc bye", ""]
    got = [r.asDict() for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [(g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got] == [
        (9, 4, 0, 6, "cc-by,reserved"), (4, 1, 1, 1, "gpl"), (15, 0, None, None, ""), (3, 0, None, None, ""), (0, 0, None, None, "")
    ]
    assert got[2]["labels"] == "apache-2.0,bsd-3-clause,mit"
    assert got[2]["permissive"] is True
    assert got[2]["score"] == 1.0
    assert len(licenses.scan(edge).collect()) == len(edge_rows)
    assert licenses.scan(empty).collect() == []


@pytest.mark.parametrize(
    ("source", "form", "ok"),
    [("MIT", "mit", True), ("MIT or GPL-2.0-only and ISC", "mit gpl-2.0-only isc and or", True), ("(MIT OR ISC) AND GPL-3.0", "mit isc or gpl-3.0 and", False),
     ("GPL-2.0 WITH Classpath OR MIT", "gpl-2.0 classpath with mit or", True), ("MIT AND", "mit", True), ("AND MIT", None, None), ("MIT */ tail", "mit", True)],
)
def test_expressions(source, form, ok):
    got = licenses.expression(source)
    assert (got and (got[0], got[2])) == (form and (form, ok))


# --- op6


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = materialise.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert (materialise.permute(p, n, 7, inverse=True) == np.arange(n)).all()
    assert (materialise.permute(np.arange(1000), 1000, 7) != materialise.permute(np.arange(1000), 1000, 8)).any()


def test_shards_hold_every_token_once(edge, edge_rows, empty, spark, tmp_path):
    index = materialise.write_shards(edge, f"file://{tmp_path}/shards", window=64, per_shard=50)
    rows = sorted(index.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    encode = packing.encoder(packing.default_tokenizer())
    want = Counter()
    for _, t in edge_rows:
        want.update(encode(t or "").tolist())
        want[0] += 1
    have = Counter()
    store, _ = pafs.FileSystem.from_uri(rows[0].path)
    for r in rows:
        with store.open_input_file(r.path.removeprefix("file://")) as f:
            f.seek(r.shard_offset)
            cells = f.read(128)
        assert zlib.crc32(cells) == r.ids_crc32
        have.update(np.frombuffer(cells, "<u2")[: r.n_tokens].tolist())
    assert have == want
    again = materialise.read_slots(index, 3, 9, window=64).orderBy("slot").collect()
    assert [r.slot for r in again] == list(range(3, 9))
    assert zlib.crc32(np.array(again[0].ids, "<u2").tobytes()) == rows[3].ids_crc32
    assert materialise.write_shards(empty, f"file://{tmp_path}/none").collect() == []


# --- op7


def test_urls_edges(spark):
    given_ = ["http://WWW.Example.COM/en/1?x", "http://sub.example.com/en/2", "http://example.net/es/", "http://a.net", None, "no url", "http://notexample.com/en/", "http://ads.site.org/x", "http://x.org/?utm_source=feed", "http://x.org/?xutm_source=feed", "ftp://m.x.org/de/1", ""]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given_)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("sub.example.com", "/en/2", "example.com/en/", "block"), 2: ("example.net", "/es/", "net/es/", "block"),
        3: ("a.net", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.com", "/en/", "com/", "allow"), 7: ("ads.site.org", "/x", None, "block"),
        8: ("x.org", "/", None, "block"), 9: ("x.org", "/", None, "allow"), 10: ("m.x.org", "/de/1", None, "block"), 11: ("", "", None, "allow"),
    }
    assert urls.judge(df.where("false")).collect() == []


def test_index_fetches_every_rule_that_matches():
    patterns = [urls.Pattern(p) for p in (*urls.PATTERN_RULES, "*foo*", "||bar.*/baz^")]
    index = urls.rarest_index(patterns, {})
    for u in ("http://blog.x.org/a", "http://x.org/?utm_source=feed", "https://m.a.com/de/x", "http://www.x.org/track/", "http://x.org/afoob", "http://bar.com/q/baz"):
        tried = {i for t in {*re.findall("[a-z0-9]+", u), ""} for i in index.get(t, ())}
        assert {i for i, p in enumerate(patterns) if p.regex.search(u)} <= tried


# --- op8


def test_toxicity_learns_words_and_beginnings(spark, edge, edge_rows, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        w = prose(i + 1, 60).split()
        bad = i % 5 == 0
        if bad:
            w[int(rng.integers(60))] = "zorvex" if i % 2 else f"quashbel{rng.choice(['a', 'on', 'ira', 'ut'])}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    y = dict(labels)
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == y[i] for i in held]) > 0.95
    odd = toxicity.score(edge, model).collect()
    assert len(odd) == len(edge_rows)
    assert all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.keep_clean(edge, model)
    assert kept.columns == edge.columns
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


# --- op9


def test_warc_round_trip_and_revisits(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "u", "WARC/1.1\r\n\r\n" * 200), (3, "again", big)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r.record_id.removeprefix("urn:page:")
        data = next((h or "") for k, _, h in rows if str(k) == i or (k is None and i == "-")).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to_id) == (("revisit", "urn:page:3") if i in "12" else ("response", None))
    assert warc.round_trip(df.where("false")).collect() == []


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_skips_what_is_broken(zipped):
    wrap = warc.member if zipped else bytes
    parts = [wrap(warc.record(f"urn:page:{i}", "http://x/", b"payload %d " % i * 50)) for i in range(4)]
    whole = b"".join(parts)
    assert [r.record_id for r in warc.salvage(whole, "f")] == [f"urn:page:{i}" for i in range(4)]
    cut = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) - 40
    cut[at : at + 8] = b"\x00" * 8
    rows = list(warc.salvage(b"junk" + bytes(cut) + parts[0][:60], "f"))
    assert [r.record_id for r in rows if r.kind == "record"] == ["urn:page:0", "urn:page:2", "urn:page:3"]
    gaps = [(r.offset, r.length) for r in rows if r.kind == "gap"]
    assert gaps == [(0, 4), (4 + len(parts[0]), len(parts[1])), (4 + len(whole), 60)]
    assert sum(r.length for r in rows) == 4 + len(whole) + 60
    assert list(warc.salvage(b"", "f")) == []


# --- op10


def test_packing_covers_every_token(edge, edge_rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(edge, pool_tokens=20_000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, text in edge_rows:
        if i in (6, 11):
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append(r)
    odd = 0
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        odd += at & (at - 1) != 0
    assert odd <= edge.rdd.getNumPartitions()
    assert packing.pack(empty).collect() == []
    assert SCHEMA.startswith("doc_id")


# --- brute force beyond the edges


def greedy_tiles(a, b, shortest):
    """The longest common free run again and again, ties by the first place in a, then in b."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= shortest and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return out
        out.append(best)
        for k in range(best[0]):
            fa[best[1] + k] = fb[best[2] + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=14), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 3))
def test_tiles_are_exactly_the_greedy_ones(a, b, shortest):
    got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), shortest)
    assert [tuple(map(int, t)) for t in got] == greedy_tiles(a, b, shortest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=3), st.lists(st.integers(1, 4), max_size=30))
def test_leaks_equal_tiling_of_whole_texts(items, doc):
    block = tiling.Block([(n, " ".join(f"w{x}" for x in i)) for n, i in enumerate(items)], 3)
    got = {d[1]: d[3][:2] for d in tiling._hits([" ".join(f"w{x}" for x in doc)], block, 0.7)}
    want = {}
    for n, item in enumerate(items):
        tiles = greedy_tiles(item, doc, min(3, len(item)))
        if sum(t[0] for t in tiles) >= 0.7 * len(item):
            want[n] = (sum(t[0] for t in tiles), len(tiles))
    assert got == want


def test_repetitive_texts_are_tiled_quickly():
    began = time.perf_counter()
    tiles = tiling.tile(np.array([1, 2] * 800, np.uint64), np.array([1, 2, 1] * 20_000, np.uint64), 4)
    assert time.perf_counter() - began < 5
    assert tiles == []
    assert sum(t[0] for t in tiling.tile(np.array([1, 2] * 800, np.uint64), np.array(([1, 2] * 5 + [9]) * 4000, np.uint64), 4)) == 1600
    assert time.perf_counter() - began < 10


BASE_SCAN = [("cc", "by"), ("general", "public", "license"), ("all", "rights", "reserved")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["CC", "by", " ", "-", "\n", "general", "Public", "license", "all", "rights", "reserved", "é", "x", ".", "9", "\x7f", "ß"]), max_size=40))
def test_base_phrases_against_brute_force(parts):
    text = "".join(parts)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    starts = [(i, p) for p in BASE_SCAN for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    phrases = tuple((p, label, "base") for p, label in licenses.BASE_PHRASES.items()) + tuple((p, label, "notice") for p, label in licenses.NOTICE_PHRASES.items())
    got = licenses.scan_text(text, (*phrases, (licenses.TAG, "", "tag")))
    label = {"cc": "cc-by", "general": "gpl", "all": "reserved"}
    places = [i for i, _ in starts]
    assert got[:5] == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({label[p[0]] for _, p in starts})))
    assert set(got[4].split(",")) <= set(got[5].split(","))
    assert 0 <= got[6] <= 1


def test_words_that_are_no_licence_after_a_tag():
    assert licenses.expression("see file") is None
    assert licenses.expression("MIT see file")[1] == ["mit"]
    assert licenses.expression("LicenseRef-Own AND GPL-2.0+")[1] == ["licenseref-own", "gpl-2.0+"]
    assert licenses.expression("(MIT")is None and licenses.expression("MIT)")[0] == "mit" and licenses.expression("((MIT) OR (ISC))")[0] == "mit isc or"


def test_long_expressions_take_time_in_proportion():
    began = time.perf_counter()
    form, names, free = licenses.expression(" AND ".join(["(MIT OR GPL-2.0)"] * 60_000))
    assert (len(names), free) == (120_000, True)
    assert licenses.expression("(" * 200_000 + "MIT") is None
    assert time.perf_counter() - began < 10


def test_host_anchors_belong_to_the_host(spark):
    given_ = ["http://x.org/?u=http://ads.evil.org/", "http://ads.evil.org/?u=http://x.org/", "x?u=http://blog.a.org", "http://x.org/http://www.a.org/track/", "http://x.org/" + "a" * 100_000 + "/track/"]
    df = spark.createDataFrame(list(enumerate(given_)), "page_id long, url string")
    got = {r.page_id: r.pattern for r in urls.judge(df).collect()}
    assert got == {0: None, 1: "||ads.", 2: "||blog.", 3: "^track^", 4: "^track^"}


def test_ten_thousand_rules_are_fetched_by_their_rarest_token(spark):
    rules = [f"^common^rare{i}^" for i in range(9_998)] + ["||ads.", "^common^"]
    given_ = [f"http://x.org/common/rare{i * 37}/" for i in range(200)] + ["http://ads.x.org/", "http://x.org/common", "http://x.org/none"]
    df = spark.createDataFrame(list(enumerate(given_)), "page_id long, url string")
    got = urls.judge(df, pattern_rules=rules).collect()
    assert max(r.candidates for r in got) <= 2
    for r in got:
        low = given_[r.page_id]
        want = next((p for p in rules if urls.Pattern(p).find(low)), None) if r.page_id % 40 == 0 or r.page_id >= 200 else r.pattern
        assert r.pattern == want


@pytest.mark.parametrize("blank_run", [4, packing.BLANK_RUN])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\x1c", "\x85", " ", "\xa0", "ab", "B'll", "7", ".", "é", "<|endoftext|>", "<|endof", "東", "​", "\r\n", "     ", "\n\n\n\n"]), max_size=20))
def test_ids_equal_the_tokenizers_library(blank_run, parts):
    text = "".join(parts)
    assert packing.encoder(packing.default_tokenizer(), blank_run)(text).tolist() == reference_tokenizer().encode(text, add_special_tokens=False).ids


def test_runs_of_blanks_take_time_in_proportion_to_their_length():
    encode, library = packing.encoder(packing.default_tokenizer()), reference_tokenizer()
    for n in (63, 64, 65, 1000, 9_999):
        text = ("word" + " " * n) * (30_000 // n)
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    text = ("word" + " " * 9_999) * 300
    began = time.perf_counter()
    encode(text)
    assert time.perf_counter() - began < 20  # 52 s where runs were searched by the pattern


@functools.lru_cache(1)
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_odd_long_texts_are_packed_and_materialised_whole(spark, tmp_path):
    texts = ["\n" * 5_000_000, " " * 1_500_000 + "x", "a<|endoftext|>b", "<|endoftext|>" * 300, prose(11, 40_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    encode = packing.encoder(packing.default_tokenizer())
    ids = {i: np.append(encode(t), 0).astype("<u4") for i, t in enumerate(texts)}
    assert ids[2].tolist()[1:-2].count(50256) == 1 and (ids[3][:-1] == 50256).all()
    by = defaultdict(list)
    for r in packing.pack(df).collect():
        by[r.doc_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(own)
    index = materialise.write_shards(df, f"file://{tmp_path}/shards").collect()
    assert sum(r.n_tokens for r in index) == sum(map(len, ids.values()))


def test_string_ids_are_refused_before_any_task(spark):
    df = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for f in (packing.pack, licenses.scan, lambda d: materialise.write_shards(d, "file:///nowhere"), ppm.score, sketches.sketch, sketches.next_likeness, lambda d: toxicity.score(d, None)):
        with pytest.raises(TypeError):
            f(df)


def test_kneser_ney_ratios_against_plain_counts():
    toxic, ordinary = {b"scum": 3, b"scab": 1, b"day": 2}, {b"day": 9, b"dab": 1, b"cab": 4}
    words_ = sorted({*toxic, *ordinary})
    model = toxicity.fit(words_, np.array([toxic.get(w, 0) for w in words_], float), np.array([ordinary.get(w, 0) for w in words_], float))
    grams = sorted({(b" " + w + b" ")[: k + 1] for w in words_ for k in range(1, len(w) + 2)})
    d = toxicity.DISCOUNT

    def below(context, byte):
        p = 1 / 257
        for k in range(toxicity.ORDER + 1):
            short = context[max(len(context) - k, 0) :]
            seen = Counter(g[-1] for g in grams if g[max(len(g) - 1 - k, 0) : -1] == short)
            if seen:
                p = (max(seen[byte] - d, 0) + d * len(seen) * p) / sum(seen.values())
        return p

    def likelihood(counts, word):
        out, s = 1.0, b" " + word + b" "
        for k in range(1, len(s)):
            next_ = Counter()
            for w, n in counts.items():
                x = b" " + w + b" "
                if x[:k] == s[:k] and len(x) > k:
                    next_[x[k]] += n
            p = below(s[:k], s[k])
            out *= (max(next_[s[k]] - d, 0) + d * len(next_) * p) / sum(next_.values()) if next_ else p
        return out

    share = toxicity.TOXIC_SHARE
    for w in (b"scum", b"scumbag", b"day", b"zzz", b"c"):
        want = math.log(1 - share + share * likelihood(toxic, w) / likelihood(ordinary, w))
        assert toxicity.log_ratios(model, [w])[0] == pytest.approx(want, rel=1e-3, abs=1e-6)


def test_toxicity_ratios_of_many_words_take_little_memory():
    """A batch may hold 100,000 words unlike each other: what is held beside them must not grow with their bytes."""
    rng = np.random.default_rng(2)
    many = [bytes(w) for w in rng.integers(97, 123, (100_000, 9), dtype=np.uint8)] + [b"", b"x" * 300_000, b"after"]
    model = toxicity.fit(many[:5_000], np.ones(5_000, np.int64), np.arange(5_000))
    tracemalloc.start()
    got = toxicity.log_ratios(model, many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    some = [0, 17, 99_999, 100_000, 100_001, 100_002]
    assert got[some].tolist() == [float(toxicity.log_ratios(model, [many[i]])[0]) for i in some]
    assert len(toxicity.log_ratios(model, [])) == 0


def test_toxicity_remembers_no_more_words_than_its_limit():
    model = toxicity.fit([b"scum", b"day"], np.array([3, 1]), np.array([1, 3]))
    ratios = toxicity.Ratios(model, limit=4)
    for batch in ([b"scum", b"day", b"a"], [b"b", b"c", b"scum"], [b"scum", b"day"]):
        assert ratios(batch).tolist() == toxicity.log_ratios(model, batch).tolist() and len(ratios.known) <= 4
    texts = ["scum day", "", "b " * 700_000, "day"]
    n, mean, strongest = toxicity.evidence(ratios, texts)
    assert n.tolist() == [2, 0, 700_000, 1] and strongest == [b"scum", None, b"b", b"day"]
    assert mean.tolist() == [float(toxicity.evidence(ratios, [t])[1][0]) for t in texts]


def test_toxicity_score_rises_with_the_ratio_and_learns_from_a_bounded_sample(spark):
    rows = [(i, f"{prose(i + 1, 30)} {'zorvex' if i % 4 == 0 else ''}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for sample_bytes in (toxicity.SAMPLE_BYTES, 8_000):
        got = sorted(toxicity.score(docs, toxicity.train(docs, labels, sample_bytes=sample_bytes)).collect(), key=lambda r: r.log_ratio)
        assert all(a.score <= b.score for a, b in zip(got, got[1:], strict=False))
        assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.95


def test_plan_counts_correlated_bits_as_they_agree():
    """Bits 0..31 are copies of one another: a part made of them alone would hold half of all fingerprints in a bucket."""
    rng = np.random.default_rng(5)
    low, high = rng.integers(0, 2, 4000).astype(np.uint64) * np.uint64(0xFFFFFFFF), rng.integers(0, 1 << 32, 4000).astype(np.uint64) << np.uint64(32)
    sample = low | high
    bits = np.array([(sample >> np.uint64(b)) & np.uint64(1) for b in range(64)], float)
    assert simhash.agreeing(sample, list(range(32)), 0) == pytest.approx(0.5, abs=0.02)
    assert simhash.within(np.full(32, 0.5), 0) < 1e-9
    masks = simhash.plan(10**6, bits.mean(1), np.corrcoef(bits), 2, sample=sample)
    for _ in range(200):
        differ = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
        assert any(m & differ == 0 for m in masks)
    worst = max(np.unique(sample & np.uint64(m), return_counts=True)[1].max() for m in masks)
    assert worst < 2100


def test_columns_of_any_name_stay(spark, edge):
    for keep in (simhash.deduplicate, jaccard.deduplicate):
        odd = edge.withColumn("_keep", F.lit("x")).withColumn("keep", F.lit(1))
        assert keep(odd).columns == odd.columns
        assert keep(odd).count() == keep(edge).count()


def test_ppm_with_small_tables_and_many_tasks(edge, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): r.score for r in ppm.score(edge).collect()}
    monkeypatch.setattr(ppm, "LOW_KEYS", 1)
    monkeypatch.setattr(ppm, "TASK_KEYS", 500)
    for r in ppm.score(edge).collect():
        assert r.score == pytest.approx(whole[r.doc_id, r.n_tokens], rel=1e-9)


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_survives_any_flipped_byte(zipped):
    wrap = warc.member if zipped else bytes
    parts = [wrap(warc.record(f"urn:page:{i}", "http://x/é", b"payload %d " % i * 9, refers_to="urn:page:9" if i == 1 else None)) for i in range(3)]
    whole = b"".join(parts)
    for at in range(len(whole)):
        for value in (whole[at] ^ 0x80, 0):
            rows = list(warc.salvage(whole[:at] + bytes([value]) + whole[at + 1 :], "f"))
            hit = next(i for i in range(3) if at < sum(map(len, parts[: i + 1])))
            found = [r.record_id for r in rows if r.kind == "record"]
            assert all(f"urn:page:{i}" in found for i in range(3) if i != hit)
            assert sum(r.length for r in {(r.offset, r.length): r for r in rows}.values()) >= len(whole) - 4
