"""Removal of word sequences that an earlier document holds, by suffix automata of reference shards.

The reference of a corpus is the corpus, so its automata can't all be broadcast.  Shards and the
documents that need them meet by key instead.  A window's key is the least hash among the short
grams in it, so equal windows have equal keys wherever they stand.  Of each key that several
documents hold the piece of the smallest id is the owner.  A shard is one owner's piece, cut down
to the words under its shared keys; a task builds its suffix automaton and streams through it the
words that other documents hold under these keys.  Their matching statistics give the windows that
the owner holds.  Windows that it lacks, though it holds their key, go through a second round whose
key is the whole window.  Shards are bounded by the size of a piece, and the documents of a
frequent key are dealt over several copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_words, materialize, mix, remove_tables, signed, texts_of, whole_numbers

#: Words of a window, and of the grams that give its key in the first round.
WINDOW, GRAM = 50, 10
#: Windows of a piece of a long document, and bytes from which a document is cut into pieces.
PIECE, LONG = 1 << 15, 1 << 17
#: Pieces that stream through one copy of a shard, about.
DEALT = 512
#: Words are compared as they are, not in lower case.
SAME = bytes(range(256))
UNITS = "dockey long, doc long, first long, text string"
SPANS = "okey long, ofirst long, odoc long, level int, salt int, query boolean, dockey long, doc long, first long, text string"
FOUND = "dockey long, doc long, start long, stop long, text string"


class Automaton:
    """Suffix automaton of word sequences: one state per set of end places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Take in one more sequence; no match runs over its ends."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            have = nexts[last].get(w)
            if have is not None and length[have] == length[last] + 1:
                last = have
                continue
            if have is not None:
                last = self._clone(last, have, w)
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: object) -> int:
        nexts, link = self.next, self.link
        new = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = new
            p = link[p]
        return new

    def matches(self, words: list) -> Iterator[int]:
        """Matching statistics: for each word the length of the longest sequence that ends there and lies in the automaton."""
        nexts, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n


def merged(starts: np.ndarray, width: int = 1) -> list[tuple[int, int]]:
    """Runs [a, b) covered by ``width`` numbers from each of the ascending ``starts``; runs that only touch are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return list(zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + width).tolist(), strict=True))


def window_keys(texts: list[str], window: int, gram: int) -> list[np.ndarray]:
    """Of each text the key of each window: the least hash of its grams."""
    words, counts = hashed_words(texts, SAME)
    n, out, at = len(words), [], 0
    h = np.zeros(max(n - gram + 1, 0), np.uint64)
    for j in range(gram):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)] + np.uint64(j + 1))
    width = window - gram + 1
    have = 1
    while have < width and len(h):  # least of 2, 4, 8, ... neighbours
        step = min(have, width - have)
        h = np.minimum(h[: max(len(h) - step, 0)], h[step:])
        have += step
    for c in counts.tolist():
        out.append(h[at : at + max(c - window + 1, 0)])
        at += c
    return out


def _units(df: DataFrame, window: int) -> DataFrame:
    """Pieces of documents (dockey, doc, first word's number, text): windows of a piece start in no other piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts_of(batch.column(2))):
                key, doc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if len(text) < LONG:
                    yield pa.RecordBatch.from_pydict({"dockey": [key], "doc": [doc], "first": [0], "text": [text]})
                    continue
                words = text.encode("utf-8", "surrogatepass").split()
                for a in range(0, max(len(words) - window + 1, 1), PIECE):
                    part = b" ".join(words[a : a + PIECE + window - 1]).decode("utf-8", "surrogatepass")
                    yield pa.RecordBatch.from_pydict({"dockey": [key], "doc": [doc], "first": [a], "text": [part]})

    long = F.length("text") >= LONG
    short = df.where(~long).select("dockey", "doc", F.lit(0).cast("long").alias("first"), "text")
    return short.union(df.where(long).select("dockey", "doc", "text").mapInArrow(run, UNITS))


def _keyed(units: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, dockey, doc, first): each key of a piece once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(k) for k in window_keys(texts_of(batch.column(3)), window, gram)]
            of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(flat)), *(batch.column(c).take(pa.array(of)) for c in range(3))], names=["key", "dockey", "doc", "first"])

    return units.select("dockey", "doc", "first", "text").mapInArrow(run, "key long, dockey long, doc long, first long")


def _spans(units: DataFrame, window: int, gram: int) -> DataFrame:
    """Words under shared keys, addressed to their owner's shard; the owner's own are its reference.

    ``units`` have ``keys``: (key, owner, level), the level being the power of two of the shard's copies.
    """

    def rows(key: int, doc: int, first: int, text: str, keys: list[dict], own: np.ndarray) -> Iterator[tuple]:
        words = text.encode("utf-8", "surrogatepass").split()
        shards: dict[tuple, list[int]] = {}
        for k in keys:
            o = k["owner"]
            shards.setdefault((o["dockey"], o["first"], o["doc"], k["level"]), []).append(k["key"])
        for (okey, ofirst, odoc, level), some in shards.items():
            starts = np.flatnonzero(np.isin(own, np.array(some, np.int64).view(np.uint64)))
            reference = (odoc, okey, ofirst) == (doc, key, first)
            # The shard's own words go to each of its copies, those of another piece to one of them.
            salts = range(1 << level) if reference else [key >> 8 & (1 << level) - 1]
            for a, b in merged(starts):
                part = b" ".join(words[a : b + window - 1]).decode("utf-8", "surrogatepass")
                for salt in salts:
                    yield okey, ofirst, odoc, level, salt, not reference, key, doc, first + a, part

    names = [f.split()[0] for f in SPANS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(3))
            out, size = [], 0
            for i, own in enumerate(window_keys(texts, window, gram)):
                head = (batch.column(c)[i].as_py() for c in range(3))
                for row in rows(*head, texts[i], batch.column(4)[i].as_py(), own):
                    out.append(row)
                    size += len(row[-1])
                    if size > 1 << 20:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    return units.select("dockey", "doc", "first", "text", "keys").mapInArrow(run, SPANS)


def _matched(spans: DataFrame, window: int) -> DataFrame:
    """Stretches of words in windows that an earlier document's shard holds (text null), and those of the windows it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, Automaton()
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in range(batch.num_columns))
            for okey, ofirst, odoc, level, salt, query, key, doc, first, text in zip(*columns, strict=True):
                if shard != (odoc, okey, ofirst, level, salt):
                    shard, automaton = (odoc, okey, ofirst, level, salt), Automaton()
                words = text.encode("utf-8", "surrogatepass").split()
                if not query:
                    automaton.add(words)
                    continue
                n = np.fromiter(automaton.matches(words), np.int64, len(words))
                held = n[window - 1 :] >= window
                if odoc < doc:
                    out += [(key, doc, first + a, first + b, None) for a, b in merged(np.flatnonzero(held), window)]
                for a, b in merged(np.flatnonzero(~held)):
                    out.append((key, doc, first + a, first + b + window - 1, b" ".join(words[a : b + window - 1]).decode("utf-8", "surrogatepass")))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())], names=["dockey", "doc", "start", "stop", "text"]
            )

    by = ["odoc", "okey", "ofirst", "level", "salt"]
    dealt = spans.repartition(*by).sortWithinPartitions(*by, "query")
    return dealt.select(*(f.split()[0] for f in SPANS.split(", "))).mapInArrow(run, FOUND)


def _round(units: DataFrame, window: int, gram: int, tag: str) -> DataFrame:
    """FOUND rows of one round: each shared key's owner against all other pieces that hold the key."""
    keyed = materialize(_keyed(units, window, gram), f"{tag}-keys")
    owner = F.min(F.struct("doc", "dockey", "first")).alias("owner")
    shared = keyed.groupBy("key").agg(owner, F.max("doc").alias("latest"), F.count(F.lit(1)).alias("n")).where("owner.doc < latest")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / DEALT))).cast("int").alias("level")
    mine = keyed.join(shared.select("key", "owner", level), "key").groupBy("dockey", "doc", "first").agg(F.collect_set(F.struct("key", "owner", "level")).alias("keys"))
    spans = materialize(_spans(units.join(mine, ["dockey", "doc", "first"]), window, gram), f"{tag}-spans")
    found = materialize(_matched(spans, window), f"{tag}-found")
    remove_tables(keyed, spans)
    return found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``df``: its id, n_words, removed and the kept text.

    ``removed`` has the maximal spans (start, stop) of words that windows of ``window`` words cover
    whose word sequence also stands in a row of a smaller id; ``kept`` joins the other words by one
    space.  Words stand between ASCII white space and are compared exactly.  A null text has no
    words.  A row with a null id keeps all its words and removes none; rows that repeat an id don't
    remove from each other.  Ids are whole numbers; other columns are not read.
    """
    whole_numbers(df, id_col)
    bounded_batches(df.sparkSession)
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc"), text.alias("text"), F.xxhash64(df[id_col].cast("long"), text).alias("dockey"))
    units = _units(docs.where(F.col("doc").isNotNull() & (F.length("text") >= 2 * window - 1)), window)
    first = _round(units, window, gram, "grams")
    # Windows that the owner of their key lacks: the key is the window itself, so that its owner holds it.
    left = first.where("text is not null").select("dockey", "doc", F.col("start").alias("first"), "text")
    second = _round(left, window, window, "windows")
    spans = first.union(second).where("text is null").select("dockey", "doc", "start", "stop")
    spans = spans.groupBy("dockey", "doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans_of, kept = [], [], []
            for text, found in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words), bool)
                for s in found or ():
                    gone[s["start"] : s["stop"]] = True
                counts.append(len(words))
                spans_of.append([{"start": a, "stop": b} for a, b in merged(np.flatnonzero(gone))])
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans_of, pa.list_(span)), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "removed", "kept"],
            )

    joined = docs.join(spans, ["dockey", "doc"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, removed array<struct<start: bigint, stop: bigint>>, kept string")
