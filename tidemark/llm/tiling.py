"""Benchmark decontamination by greedy string tiling.

Runs of ``seed`` words of the benchmark items are joined with those of the documents; where an
item's seeds could cover enough of it, the longest non-overlapping matches are marked again and
again (running Karp-Rabin: the match length falls from the longest, and rolling hashes of that
length find the places), and the share of the item's words under tiles decides.  Order does not
matter, so reordered passages are caught.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, bounded_batches, hashed_words, mix, shingle_hashes, texts_of, whole_numbers

#: Words of a seed, which is also the shortest tile, and the covered share from which an item counts as leaked.
SEED, COVERAGE = 4, 0.7
#: Bytes of benchmark texts that tasks hold at once; a larger benchmark is matched in blocks of this size.
BLOCK_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, item_id long, item_words long, matched_words long, tiles long, coverage double, first_word long, last_word long"


class Block:
    """The items of one block: their words' hashes, and their seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        words, counts = hashed_words([t or "" for _, t in items], WORD_BYTES)
        cuts = np.cumsum(counts)[:-1]
        self.items = [(i, w) for (i, _), w in zip(items, np.split(words, cuts), strict=True)] if items else []
        # An item shorter than a seed is one seed as a whole, of its own length.
        self.sizes = sorted({min(seed, len(w)) for _, w in self.items if len(w)})
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.own: dict[int, np.ndarray] = {}
        for k in self.sizes:
            h, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for n, (_, w) in enumerate(self.items):
                if len(w) and min(seed, len(w)) == k:
                    self.own[n] = shingle_hashes(w, np.array([len(w)]), k)[0]
                    g = np.unique(self.own[n])
                    h.append(g)
                    of.append(np.full(len(g), n))
            hashes, owners = np.concatenate(h), np.concatenate(of)
            by = np.argsort(hashes, kind="stable")
            self.seeds[k] = hashes[by], owners[by]

    def candidates(self, words: np.ndarray, counts: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(document, item, seed length, seeds of the document that are some item's, their places in it).

        Items whose seeds in the document can't cover enough of it are left out: each distinct seed's
        places in the item are counted once.  The documents' seeds are hashed once for all items.
        """
        for k in self.sizes:
            hashes, owners = self.seeds[k]
            h, size = shingle_hashes(words, counts, k)
            place = np.searchsorted(hashes, h)
            place[place == len(hashes)] = 0
            hit = np.flatnonzero(hashes[place] == h)
            upto = np.cumsum(size)
            document = np.searchsorted(upto, hit, side="right")
            edges = np.flatnonzero(np.r_[True, np.diff(document) != 0, True]) if len(hit) else np.zeros(1, np.int64)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d = int(document[x])
                if counts[d] < k:
                    continue
                at = hit[x:y] - (upto[d] - size[d])
                seeds = h[hit[x:y]]
                distinct = np.unique(seeds)
                first, last = np.searchsorted(hashes, distinct, side="left"), np.searchsorted(hashes, distinct, side="right")
                found = np.concatenate([owners[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)])
                for n in np.unique(found).tolist():
                    item, own = self.items[n][1], self.own[n]
                    if covered(np.isin(own, distinct), k, len(item)) >= coverage * len(item):
                        mine = np.isin(seeds, own)
                        yield d, n, k, seeds[mine], at[mine]


def covered(starts: np.ndarray, k: int, n: int) -> int:
    """How many of ``n`` words lie in the runs of ``k`` that start where ``starts`` is set."""
    step = np.zeros(n + 1, np.int64)
    step[: len(starts)] += starts
    step[k : k + len(starts)] -= starts
    return int((np.cumsum(step)[:n] > 0).sum())


class Grams:
    """Rolling hashes of a sequence's runs of any length: a polynomial of its words, by differences of running sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up, self.down = (np.multiply.accumulate(np.full(max(n, 1), np.uint64(b))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=self.total[1:])
        self.free = np.ones(n, bool)

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``k`` free words stand, and the hashes of those runs."""
        n = len(self.free)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        upto = np.concatenate([[0], np.cumsum(self.free)])
        at = np.flatnonzero(upto[k:] - upto[:-k] == k)
        # A run's sum starts at its place's power: taken back to the first, equal runs are equal anywhere.
        return at, mix((self.total[at + k] - self.total[at]) * self.down[at])


def tile(item: np.ndarray, document: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(length, item place, document place) of the tiles, longest first; ties by item place, then document place.

    A length's matches are marked in one walk over the item: a document place that a tile has
    taken never comes free, so each place is looked at once however often the texts repeat.
    """
    words = np.unique(item)
    a = np.searchsorted(words, item).astype(np.int64) + 1
    shared = np.isin(document, words)
    b = np.where(shared, np.searchsorted(words, document) + 1, 0)
    mine, theirs = Grams(a.astype(np.uint64)), Grams(b.astype(np.uint64))
    theirs.free = b > 0
    tiles: list[tuple[int, int, int]] = []
    length = min(len(a), int(shared.sum()))
    while length >= shortest:
        # Binary search for the longest length at which any free runs agree.
        low, high, best = shortest, length, 0
        while low <= high:
            k = (low + high) // 2
            if np.isin(theirs.open(k)[1], mine.open(k)[1]).any():
                best, low = k, k + 1
            else:
                high = k - 1
        if not best:
            break
        (at_a, hash_a), (at_b, hash_b) = mine.open(best), theirs.open(best)
        keep = np.isin(hash_b, hash_a)
        at_b, hash_b = at_b[keep], hash_b[keep]
        by = np.argsort(hash_b, kind="stable")
        places, values = at_b[by].tolist(), hash_b[by]
        first, last = np.searchsorted(values, hash_a, side="left"), np.searchsorted(values, hash_a, side="right")
        upto: dict[int, int] = {}
        for i, x, y in zip(at_a.tolist(), first.tolist(), last.tolist(), strict=True):
            if x == y or not mine.free[i : i + best].all():
                continue
            p = upto.get(x, x)
            while p < y and not theirs.free[places[p] : places[p] + best].all():
                p += 1
            upto[x] = p
            if p < y and (a[i : i + best] == b[places[p] : places[p] + best]).all():
                tiles.append((best, i, places[p]))
                mine.free[i : i + best] = theirs.free[places[p] : places[p] + best] = False
        length = best - 1
    return tiles


def match(words: np.ndarray, item: np.ndarray, k: int, at: np.ndarray, coverage: float) -> tuple[int, int, int, int] | None:
    """(matched words, tiles, first and last word in the document) if tiles cover enough of the item, whose seeds of ``k`` words start at ``at``."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    inside = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    # Runs that are apart in the document stay apart: a word that is in no item stands between.
    gap = np.flatnonzero(np.diff(inside) > 1) + 1
    kept, place = np.insert(words[inside], gap, np.uint64(0)), np.insert(inside, gap, -1)
    tiles = tile(item, kept, k)
    matched = sum(t[0] for t in tiles)
    if matched < coverage * len(item):
        return None
    return matched, len(tiles), min(int(place[j]) for _, _, j in tiles), max(int(place[j + n - 1]) for n, _, j in tiles)


def leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item whose tiles cover ``coverage`` of the item's words or more.

    Words are runs of letters, digits and non-ASCII, A-Z lower-cased.  The items' size is read
    first; they go to the tasks in blocks of ``block_bytes`` at most, so a large benchmark takes
    more passes over the documents and never more memory.  Items without words and documents
    without text match nothing, an empty table gives no rows; an item of fewer words than a seed must
    occur whole; repeated rows and items give a row each; null ids are returned as null; a very long
    text is matched whole by one task; other columns are not read.
    """
    whole_numbers(df, id_col)
    whole_numbers(benchmark, item_col)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    out = None
    for rows in _blocks(benchmark, item_col, item_text_col, block_bytes):
        found = docs.mapInArrow(_matcher(rows, seed, coverage), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text; one empty block if there are none."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def _hits(texts: list[str], block: Block, coverage: float) -> Iterator[tuple[int, int, np.ndarray, tuple]]:
    """(document number, item id, item words, match) of each leaked item."""
    words, counts = hashed_words(texts, WORD_BYTES)
    first = np.concatenate([[0], np.cumsum(counts)])
    for d, n, k, _, at in sorted(block.candidates(words, counts, coverage), key=lambda c: c[:2]):
        item_id, item = block.items[n]
        if hit := match(words[first[d] : first[d + 1]], item, k, at, coverage):
            yield d, item_id, item, hit


def _matcher(rows: list[tuple[int, str]], seed: int, coverage: float):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.float64() if f.endswith("double") else pa.int64() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(rows, seed)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [
                (ids[d], i, len(item), hit[0], hit[1], hit[0] / len(item), hit[2], hit[3])
                for d, i, item, hit in _hits(texts_of(batch.column(1)), block, coverage)
            ]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def decontaminate(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, columns unchanged; one pass a block, no shuffle.

    Null and empty texts hold none and stay; repeated rows stay or go alike; an empty table or
    benchmark changes nothing.
    """
    at = df.columns.index(text_col)

    def cleaner(rows: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(rows, seed)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for d, *_ in _hits(texts_of(batch.column(at)), block, coverage):
                    keep[d] = False
                yield batch.filter(pa.array(keep))

        return run

    for rows in _blocks(benchmark, item_col, item_text_col, block_bytes):
        df = df.mapInArrow(cleaner(rows), df.schema)
    return df
