"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.  Correlated bits
are grouped into parts; dynamic programming gives each part its own distance threshold (-1: the
part is not probed) from estimated candidate counts, so that any two fingerprints within the
distance agree with one part's threshold.  Every fingerprint is probed under its part keys, and
each candidate pair is verified.  Large buckets are never expanded into pairs: their members
meet under the points of their 1-ball, which hold 65 fingerprints at most and lose no link.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, remove_tables, texts_of, words_of

BITS = 64
#: Fingerprints from which candidate counts are estimated, about.
SAMPLE = 1 << 13
#: Buckets up to this size are compared pair by pair; larger ones link through shared points.
PAIR_BUCKET = 64


def shingle_values(text: str, k: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words, repeats included (fewer words: of the whole sequence)."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h, run = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        return np.array([h(run, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-k] + 1).tolist()]
    return np.array([h(run[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half the values."""
    if not len(values):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        block = values[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; a null or wordless text has fingerprint zero."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_values(t, k, seed)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, each bit's share, and the bits' correlations, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
            n, total = n + len(x), total + x.T @ x
        if n:
            at = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at[0] * BITS + at[1], -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["cell", "n"]
            )

    # At most 2,081 rows, whatever the input.
    cells = {r.cell: r.n for r in fps.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = int(cells.pop(-1, 0))
    both = np.zeros((BITS, BITS))
    for cell, v in cells.items():
        both[cell // BITS, cell % BITS] = both[cell % BITS, cell // BITS] = v
    share = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    return n, share, (both / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd)


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to parts of nearly equal size, each next bit being the one most correlated with its part."""
    left, out, strength = set(range(BITS)), [], np.abs(correlation)
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        first = max(left, key=lambda b: (strength[b, sorted(left)].sum(), -b))
        part = [first]
        left.discard(first)
        while len(part) < size:
            nearest = max(left, key=lambda b: (strength[b, part].sum(), -b))
            part.append(nearest)
            left.discard(nearest)
        out.append(sorted(part))
    return out


def within(differ: np.ndarray, most: int) -> float:
    """Chance that at most ``most`` of the bits differ, from each bit's chance to differ, as if they were independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return float(chance.sum())


def agreeing(sample: np.ndarray, bits: list[int], most: int) -> float:
    """Share of the sample's pairs that differ in at most ``most`` of the bits, from histograms of the bits' values.

    Values count as they occur together, so correlated bits agree as often as they do.  For
    ``most`` over 0 the pairs are counted under each choice of bits left out, an upper estimate.
    """
    n = len(sample)
    if n < 2:
        return 0.0
    whole = sum(1 << b for b in bits)
    pairs = 0.0
    for out in itertools.combinations(bits, most):
        _, counts = np.unique(sample & np.uint64(whole & ~sum(1 << b for b in out)), return_counts=True)
        pairs += float((counts.astype(np.float64) * (counts - 1)).sum())
    return pairs / (n * (n - 1.0))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1, 0, 1, ...) of the parts that sum to ``total`` at the least cost; costs[i][t + 1] is part i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, len(part) - 1):
                new = (cost + part[t + 1], [*chosen, t])
                if done + t not in step or new[0] < step[done + t][0]:
                    step[done + t] = new
        best = step
    return best.get(total, (math.inf, []))


def plan(n: int, share: np.ndarray, correlation: np.ndarray, distance: int, most_parts: int = 5, sample: np.ndarray | None = None) -> list[int]:
    """The masks under which fingerprints meet: two within ``distance`` agree on at least one of them.

    A part of threshold t is probed by agreement on all but any t of its bits, which is the same
    as enumerating the values within t.  Candidate counts are estimated from histograms of a
    ``sample`` of fingerprints, without one from the bits' shares; a poor estimate costs time and
    loses no pair.
    """
    differ = 2 * share * (1 - share)
    counted = sample is not None and len(sample) > 1
    least = 1.0 / len(sample) ** 2 if counted else 0.0
    best: tuple[float, list[int]] = (math.inf, [])
    # Numbers of parts near one more than the distance first: dearer probes than the best plan need no estimate.
    for parts in sorted(range(1, most_parts + 1), key=lambda p: abs(p - distance - 1)):
        groups = grouped_bits(correlation, parts)
        costs = []
        for bits in groups:
            row = [0.0]
            for t in range(min(distance, len(bits)) + 1):
                probes = n * math.comb(len(bits), t) * 4.0
                if probes >= best[0]:
                    row.append(math.inf)
                    continue
                pairs = max(agreeing(sample, bits, t), least) if counted else within(differ[bits], t)
                row.append(probes + 0.5 * n * n * pairs)
            costs.append(row)
        cost, thresholds = allocate(costs, distance - parts + 1)
        if thresholds and cost < best[0]:
            masks = []
            for bits, t in zip(groups, thresholds, strict=True):
                if t >= 0:
                    whole = sum(1 << b for b in bits)
                    masks += [whole & ~sum(1 << b for b in out) for out in itertools.combinations(bits, t)]
            best = (cost, masks)
    return best[1]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct fingerprints of ``fps`` (fp, rep) as all pairs within ``distance`` would.

    Pairs of small buckets are all there; in large buckets each member links to the smallest
    member at a shared point.  Distances over 2 have no such points and use pairs alone.
    """
    n, share, correlation = bit_statistics(fps)
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(n // SAMPLE, 1))) == 0).select("fp").toArrow()  # about SAMPLE longs
    masks = plan(n, share, correlation, distance, sample=some.column("fp").to_numpy().astype(np.int64).view(np.uint64))
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", "rep", F.explode(keys).alias("k")).select("k.part", "k.value", "fp", "rep")
    shared = keyed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, ["part", "value"]), "buckets")
    small = members if distance > 2 else members.where(F.col("n") <= PAIR_BUCKET)
    a, b = small.alias("a"), small.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, same & near).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
    if distance > 2:
        return materialize(pairs.distinct(), "links")
    # Two fingerprints differ in at most 2 bits just if some point differs from each in at most 1.
    flips = F.array(*[F.lit(_signed(0 if i == BITS else 1 << i)) for i in range(BITS + 1)])
    points = members.where(F.col("n") > PAIR_BUCKET).select("fp", "rep").distinct().select(
        "rep", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point")
    )
    met = points.groupBy("point").agg(F.collect_list("rep").alias("reps"), F.min("rep").alias("a")).where(F.size("reps") > 1)
    stars = met.select("a", F.explode("reps").alias("b")).where("a < b")
    out = materialize(pairs.union(stars).distinct(), "links")
    remove_tables(members)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b), for each node that has one.

    Rounds of large-star and small-star steps; each is an aggregate and a join, and each round's
    links are written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    kept, before = [], None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct(), "stars")
        r = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        remove_tables(*kept)
        if (r.n, r.h) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        kept, before = [now], (r.n, r.h)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2, seed: int = 42
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over fingerprints at ``distance`` or fewer
    differing bits, the row's own included.  Null and wordless texts have fingerprint zero and are
    linked like any other; a null id is returned as a row and never names a component unless all
    ids of its fingerprint are null; repeated rows are returned each; an empty table gives no rows; a
    very long text is read whole by one task, its votes summed block by block; other columns are not read.
    """
    docs = materialize(fingerprints(df, id_col, text_col, k, seed), "fingerprints")
    fps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    linked = components(links(fps.where("rep is not null"), distance))
    of = fps.join(linked, fps.rep == linked.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return docs.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``df`` without all but one of each near-duplicate group: the row of the smallest id stays.

    Columns are unchanged, whatever their names.  Rows with a null id can't be told apart and stay; of
    rows that repeat an id all stay or all go; an empty table stays empty.
    """
    return keep_ids(df, near_duplicates(df, id_col, text_col, k, distance).where("doc_id = component_id").select("doc_id"), id_col)


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is among the ``ids`` (one column), and those without an id; columns unchanged."""
    # One scan: rows with a null id take part in the join under a key that is always kept.
    never = "-"
    key = f"keep-{uuid.uuid4().hex}"
    kept = ids.select(F.col(ids.columns[0]).cast("string").alias(key)).distinct().union(df.sparkSession.range(1).select(F.lit(never)))
    return df.join(kept, F.coalesce(df[id_col].cast("string"), F.lit(never)) == kept[key], "left_semi")
