"""Merkle manifest of a dataset: an authentication path for every row.

Rows of a group are the leaves of its tree in a given order; runs of ``ARITY`` nodes become their
parent, and the groups' roots form one last tree.  Leaves are ranked by range partitioning and cut
into aligned blocks; a block's task walks its leaves once, while a treehash stack per level builds
the next run of that level one leaf at a time, so it holds a logarithmic number of nodes beside the
block's leaves.  Blocks' own roots are the leaves of the next round, and the path above a block is
appended to the paths inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY = 8
#: Levels of a block; it has ARITY ** HEIGHT leaves at most.
HEIGHT = 4
_PATH = "places array<int>, siblings array<string>"


def digest(parts: list[str] | tuple[str, ...]) -> str:
    """Lower-case hex SHA-256 of hex digests written one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its number of UTF-8 bytes, ``:``, and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def proof(siblings: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's level up."""
    return F.sha2(F.concat_ws("", siblings), 256)


def fold(start: Column, places: Column, siblings: Column) -> Column:
    """The root that ``start`` and a path give: on each level the node takes its place among its siblings."""

    def up(node: Column, level: Column) -> Column:
        at = level["place"] * 64
        return F.sha2(F.concat(F.substr(level["others"], F.lit(1), at), node, F.substr(level["others"], at + 1)), 256)

    return F.aggregate(F.arrays_zip(places.alias("place"), siblings.alias("others")), start, up)


class Treehash:
    """Builds nodes of one level from leaves: a stack of unfinished runs, one for each level below."""

    def __init__(self, level: int, arity: int = ARITY):
        self.arity = arity
        self.stack: list[list[str]] = [[] for _ in range(level)]
        self.out: list[str] = []

    def add(self, node: str) -> None:
        for run in self.stack:
            run.append(node)
            if len(run) < self.arity:
                return
            node = digest(run)
            run.clear()
        self.out.append(node)

    def end(self) -> None:
        """No leaf follows: short runs are closed from below."""
        node = None
        for run in self.stack:
            if node is not None:
                run.append(node)
            node = digest(run) if run else None
            run.clear()
        if node is not None:
            self.out.append(node)


def height_of(n: int, arity: int = ARITY) -> int:
    """Levels between ``n`` leaves and their one root."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def top(leaves: list[str], height: int, arity: int = ARITY) -> str:
    hashed = Treehash(height, arity)
    for x in leaves:
        hashed.add(x)
    hashed.end()
    return hashed.out[0]


def paths(leaves: list[str], height: int, arity: int = ARITY) -> Iterator[list[tuple[int, str]]]:
    """Per leaf its place and its siblings (one string) on each level of a tree of ``height``, leaf by leaf.

    ``runs[h]`` is the run of nodes of level h that the leaf's ancestor belongs to and ``ahead[h]``
    the treehash of the run that follows; it takes one leaf for each leaf passed, so the next
    run is ready when it is needed.
    """
    n, runs, ahead, fed = len(leaves), [], [], []

    def hashed(level: int, lo: int, hi: int) -> list[str]:
        t = Treehash(level, arity)
        for x in leaves[lo:hi]:
            t.add(x)
        if hi >= n:
            t.end()
        return t.out

    for h in range(height):
        span = arity ** (h + 1)
        runs.append(hashed(h, 0, min(span, n)))
        ahead.append(Treehash(h, arity))
        fed.append(span)
    for i in range(n):
        if i:
            for h in range(height):
                if i % arity ** (h + 1) == 0:
                    runs[h], ahead[h] = ahead[h].out, Treehash(h, arity)
        out = []
        for h in range(height):
            at = i // arity**h % arity
            run = runs[h]
            out.append((at, "".join(run[:at]) + "".join(run[at + 1 :])))
            if fed[h] < n:
                ahead[h].add(leaves[fed[h]])
                fed[h] += 1
                if fed[h] == n:
                    ahead[h].end()
        yield out


def ranked(df: DataFrame, tree: str, order: list[str], tag: str) -> DataFrame:
    """``df`` with ``pos``, a row's rank in its tree, and ``size``, the tree's rows.

    Ranges of (tree, order) are sorted by a task each and written; counts of ranges give the offsets.
    Rows equal in all of these are told apart by a number, so that no range grows with their repeats.
    """
    keys = [tree, *order, "again"]
    dealt = df.withColumn("again", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialize(dealt.withColumn("row", F.monotonically_increasing_id()).drop("again"), tag)
    part, row = F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = written.groupBy(tree, part).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(tree).orderBy("part")
    counts = counts.select(
        tree, "part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(tree)).alias("size")
    )
    # One row per range and tree in it: small, but joined by key unless Spark finds it small enough to broadcast.
    counts = materialize(counts, f"{tag}-counts")
    return written.withColumn("part", part).join(counts, [tree, "part"]).withColumn("pos", row + F.col("shift")).drop("part", "row", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, size, node): each block's root; of a tree of one block that is the tree's own root."""
    wide = ARITY**HEIGHT

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        node = top(table.column("node").to_pylist(), min(height_of(size), HEIGHT))
        return pa.table({"tree": table.column("tree")[:1], "block": table.column("block")[:1], "size": pa.array([size]), "node": [node]})

    dealt = nodes.select("tree", F.floor(F.col("pos") / wide).alias("block"), "pos", "size", "node")
    return dealt.groupBy("tree", "block").applyInArrow(run, "tree string, block long, size long, node string")


def _authenticated(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Each node with its path: inside its block, then the block's own path in ``upper``; subroot and root come from there."""
    wide = ARITY**HEIGHT
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name not in ("tree", "pos", "size", "node")]
    names = ["tree", "pos", "node", *(k.split()[0] for k in kept)]
    schema = ", ".join(["tree string", "pos long", "node string", *kept, _PATH, "subroot string", "root string"])

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.num_rows
        rest = above.select(["places", "siblings", "subroot", "root"]).to_pylist()[0]
        height = min(height_of(table.column("size")[0].as_py()), HEIGHT)
        each = height + len(rest["places"])
        places, siblings = [], []
        for path in paths(table.column("node").to_pylist(), height):
            places += [p for p, _ in path] + rest["places"]
            siblings += [s for _, s in path] + rest["siblings"]
        offsets = pa.array(range(0, each * n + 1, each) if each else [0] * (n + 1), pa.int32())
        columns = {c: table.column(c) for c in names} | {
            "places": pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
            "siblings": pa.ListArray.from_arrays(offsets, pa.array(siblings, pa.string())),
            "subroot": pa.array([rest["subroot"]] * n, pa.string()),
            "root": pa.array([rest["root"]] * n, pa.string()),
        }
        return pa.table(columns)

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / wide))
    return dealt.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, schema)


def _climb(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """Paths of all ``nodes`` (tree, pos, size, node, more); ``above`` gives what follows (tree, subroot) on each tree's path."""
    wide, rounds, tops = ARITY**HEIGHT, [nodes], None
    while True:
        done = materialize(_blocks(rounds[-1]), f"{tag}-blocks")
        ended = done.where(F.col("size") <= wide).select("tree", F.lit(len(rounds) - 1).alias("round"), F.col("node").alias("subroot"))
        tops = ended if tops is None else tops.union(ended)
        more = done.where(F.col("size") > wide)
        if more.isEmpty():
            break
        rounds.append(more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / wide).alias("size"), "node"))
    ends = materialize(above(tops), f"{tag}-ends").join(tops.select("tree", "round"), "tree")
    want = ["tree", "block", "places", "siblings", "subroot", "root"]
    upper = None
    for i in range(len(rounds) - 1, -1, -1):
        here = ends.where(F.col("round") == i).withColumn("block", F.lit(0).cast("long")).select(*want)
        upper = here if upper is None else here.union(upper)
        found = _authenticated(rounds[i], upper)
        if i:
            upper = materialize(found.withColumn("block", F.col("pos")).select(*want), f"{tag}-upper")
    return found


def manifest(df: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: the columns of ``keep``, leaf, pos, places, siblings, subroot and root.

    ``leaf`` is the digest of the ``fields``; leaves of one ``group`` (null is a group) stand in
    ascending ``order`` (nulls first; rows of equal order by their leaves, and equal rows are leaves
    of their own).  ``places`` and ``siblings`` are the path from the leaf to the root over the
    group's root ``subroot``: on each level the node's place in its run and the run's other
    nodes, one string of hex digests.  Groups are ordered by their UTF-8 bytes, null first.  Any
    text enters whole; an empty table gives no rows; other columns are not read, so their names
    can't clash, but names in ``keep`` must differ from those above.
    """
    keep = keep or {}
    own = {"leaf", "pos", "places", "siblings", "subroot", "root"}
    if own & set(keep):
        raise ValueError(f"columns of the manifest have these names: {sorted(own & set(keep))}")
    carried = [c.alias(f"keep{i}") for i, c in enumerate(keep.values())]
    # A group's key sorts as its bytes do, after the null group's empty key.
    tree = F.coalesce(F.concat(F.lit("="), df[group].cast("string")), F.lit("")).alias("tree")
    nodes = df.select(tree, df[order].alias("order"), leaf(*(df[f] for f in fields)).alias("node"), *carried)
    nodes = ranked(nodes, "tree", ["order", "node"], "leaves").drop("order")

    def forest(tops: DataFrame) -> DataFrame:
        """The groups' roots are the leaves of the last tree."""
        one = tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("node"))

        def end(last: DataFrame) -> DataFrame:
            empty = F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings")
            return last.select("tree", *empty, F.lit(None).cast("string").alias("subroot"), F.col("subroot").alias("root"))

        found = _climb(ranked(one, "tree", ["group"], "forest"), end, "forest")
        return found.select(F.col("group").alias("tree"), "places", "siblings", F.col("node").alias("subroot"), "root")

    found = _climb(nodes, forest, "groups")
    return found.select(*(F.col(f"keep{i}").alias(name) for i, name in enumerate(keep)), F.col("node").alias("leaf"), "pos", "places", "siblings", "subroot", "root")
