"""The Merkle manifest against a tree built by hand, level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    forest = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, _, node, doc) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((doc, node, trees[g][-1][0], forest[-1][0], path(trees[g], i) + path(forest, at)))
    return out


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513, 700])
def test_paths_of_one_block(n):
    leaves = [H(str(i)) for i in range(n)]
    tree = levels(leaves)
    height = merkle.height_of(n)
    assert height == len(tree) - 1 and merkle.top(leaves, height) == tree[-1][0]
    for extra in (0, 2):  # a last block climbs higher than it needs to
        for i, got in enumerate(merkle.paths(leaves, height + extra)):
            want = [(p, "".join(s)) for p, s in path(tree, i)]
            assert got == want + [(0, "")] * extra


def test_a_treehash_holds_less_than_a_run_per_level():
    t = merkle.Treehash(4)
    for i in range(8**4):
        t.add(str(i))
        assert all(len(run) < 8 for run in t.stack)
    assert len(t.out) == 1


def rows_of(found):
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, [(p, s) for p, s in zip(r.places, r.siblings)]) for r in found.collect()), key=key
    )


def test_trees_of_several_blocks_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rng = random.Random(5)
    rows = [(i, "s", rng.choice(["en"] * 8 + ["de", "fr", None]), i % 7, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = rows_of(merkle.manifest(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}))
    want = sorted(((*r[:4], [(p, "".join(s)) for p, s in r[4]]) for r in brute(rows)), key=key)
    assert got == want


def test_many_groups_make_a_forest_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, None, f"l{i % 90}é", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = rows_of(merkle.manifest(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}))
    assert got == sorted(((*r[:4], [(p, "".join(s)) for p, s in r[4]]) for r in brute(rows)), key=key)


def test_edges(spark, edge, edge_rows):
    rows = [(i, "s", "en", 0, t) for i, t in edge_rows]
    got = rows_of(merkle.manifest(edge.withColumn("tree", F.lit(1)).withColumn("pos", F.lit(2)), FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}))
    assert got == sorted(((*r[:4], [(p, "".join(s)) for p, s in r[4]]) for r in brute(rows)), key=key)


def test_an_empty_table_and_a_single_leaf(spark, empty):
    assert merkle.manifest(empty, FIELDS, "lang", "doc_id").count() == 0
    one = spark.createDataFrame([(1, "s", None, 3, "Abc")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(one, FIELDS, "lang", "doc_id").first()
    assert r.leaf == r.subroot == r.root == leaf(1, "s", None, 3, "Abc") and not r.places


def test_names_of_the_manifest_are_refused(empty):
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(empty, FIELDS, "lang", "doc_id", {"root": F.col("doc_id")})


def test_the_query_finds_what_was_tampered(spark, tmp_path):
    rows = [(i, "s", ["en", "de", None][i % 3], None if i % 5 == 0 else i, None if i % 11 == 0 else ("Text A" if i % 2 else "text b") + str(i)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_merkle(spark, f"file://{tmp_path}").collect()}
    text = {r[0]: r[4] for r in rows}
    for doc, node, subroot, root, steps in brute(rows):
        r = got[doc]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (node, subroot, root, H(*("".join(s) for _, s in steps)))
        changed = zlib.crc32(str(doc).encode()) % 3 == 0 and text[doc] is not None and text[doc] != text[doc].lower()
        assert r.verified == (not changed) == (r.folded_root == root)
    assert 0 < sum(not r.verified for r in got.values()) < 100
