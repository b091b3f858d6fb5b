"""Language-model scores by prediction by partial matching over bytes, beside a unigram baseline.

A text is its lower-cased words, each followed by one space, and an end symbol.  The context
trie of ``ORDER`` bytes is counted over the training rows, as a table of (context, symbol) keys
that grows with the corpus.  A symbol is predicted from its longest context that was seen; where
the context lacks it, method C's escape (one count for each symbol seen there) leads to the next
shorter context, from which the symbols already ruled out are excluded.  With fixed counts the
excluded symbols are just those of the longer context, so every key's probability is computed
once, by tasks that hold all contexts with the same last three bytes; shorter contexts are a
table of at most 256 ** 3 keys.

Scoring reads the most frequent keys from a broadcast table of at most ``HEAD`` rows of each
kind; the other keys of each document are joined with the whole table, so no key is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, signed, span_hashes, texts_of, whole_numbers, words_of

ORDER, LOW = 5, 2
#: Rows of each broadcast table.
HEAD = 1 << 19
#: Most keys of the shared table of short contexts, and keys that a task computes probabilities of, about.
LOW_KEYS, TASK_KEYS = 1 << 21, 1 << 21
#: Bytes of text that a task works on at once.
CHUNK_BYTES = 1 << 20
END = 255
GRAM, WORD = 0, 1
#: The end token among the words: no word hashes to it but by chance of 2 ** -64.
END_KEY = np.uint64(0x5EED0F7E87)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def chunks(texts: list[str], bytes_: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts) of consecutive runs of about ``bytes_``."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 8
        if size >= bytes_ or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def keys_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram keys, grams of each text, word keys, tokens of each text), end symbols and end tokens included.

    A gram key holds the symbol in its lowest byte and the context's bytes above, the last first.
    """
    pad = bytes([END]) * order
    runs = [words_of(t) for t in texts]
    lines = [b"".join([b" ".join(w), b" "]) if w else b"" for w in runs]
    data = np.frombuffer(pad + pad.join(lines) + pad, dtype=np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(size + order)
    gram = np.zeros(len(data) - order, dtype=np.uint64)
    for j in range(order + 1):
        gram |= data[order - j : len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    predicted = np.ones(len(gram), bool)
    if order > 1:
        predicted[(end[:, None] - order + np.arange(1, order)).ravel()] = False
    # Words lie between spaces and text edges.
    edge = np.flatnonzero((data == 32) | (data == END))
    start, stop = edge[:-1] + 1, edge[1:]
    word = span_hashes(data, start[stop > start], stop[stop > start])
    counts = np.fromiter(map(len, runs), np.int64, len(runs))
    tokens = np.full(int(counts.sum()) + len(runs), END_KEY)
    at = np.ones(len(tokens), bool)
    at[np.cumsum(counts + 1) - 1] = False
    tokens[at] = word
    return gram[predicted], size + 1, tokens, counts + 1


class Counter:
    """Counts of keys in one task, in training rows and in all rows; given out when many."""

    def __init__(self, kind: int, limit: int = 1 << 19):
        self.kind, self.limit = kind, limit
        self.keys, self.train, self.all = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        parts = [(self.keys, self.train, self.all)]
        for own, is_train in ((keys[train], True), (keys[~train], False)):
            u, n = np.unique(own, return_counts=True)
            parts.append((u, n if is_train else np.zeros_like(n), n))
        keys, train, both = (np.concatenate(p) for p in zip(*parts, strict=True))
        by = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(keys[by]) != 0]) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[by][first]
        self.train, self.all = (np.add.reduceat(v[by], first) if len(first) else v for v in (train, both))

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(self.keys), self.kind, np.int32)), pa.array(signed(self.keys)), pa.array(self.train), pa.array(self.all)],
            names=["kind", "key", "n", "n_all"],
        )
        self.__init__(self.kind, self.limit)
        return out


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n, n_all) of (doc_id, held_out, text): counts in training rows and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counter(GRAM), Counter(WORD)
        for batch in batches:
            train, texts = ~np.array(batch.column(1).to_pylist(), dtype=bool), texts_of(batch.column(2))
            for first, part in chunks(texts):
                gram, size, token, count = keys_of(part, order)
                own = train[first : first + len(part)]
                grams.add(gram, np.repeat(own, size))
                words.add(token, np.repeat(own, count))
                for c in (grams, words):
                    if len(c.keys) >= c.limit:
                        yield c.take()
        yield grams.take()
        yield words.take()

    rows = docs.mapInArrow(run, "kind int, key long, n long, n_all long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


class Level:
    """Counts of one order: grams and contexts in order of their keys."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        """``gram`` is distinct and sorted."""
        self.gram, self.n = gram, n.astype(np.float64)
        first = np.flatnonzero(np.r_[True, np.diff(gram >> np.uint64(8)) != 0]) if len(gram) else np.zeros(0, np.int64)
        self.context = (gram >> np.uint64(8))[first]
        self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0)
        self.kinds = np.diff(np.r_[first, len(gram)]).astype(np.float64)
        self.first = first

    @staticmethod
    def shorter(gram: np.ndarray, n: np.ndarray, order: int) -> Level:
        """The level of ``order`` under longer grams."""
        key = gram & np.uint64((1 << 8 * (order + 1)) - 1)
        u, inverse = np.unique(key, return_inverse=True)
        return Level(u, np.bincount(inverse, n, len(u)))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def excluded(self, below: Level, order: int) -> np.ndarray:
        """For each context, how many counts its symbols have in its own shorter context in ``below``."""
        mask = np.uint64((1 << 8 * order) - 1)
        at = Level.find(below.gram, self.gram & mask)
        return np.add.reduceat(np.where(at >= 0, below.n[at], 0.0), self.first) if len(self.first) else np.zeros(0)


def log_probabilities(query: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram; levels[k] has the contexts of k bytes, complete for the queries' contexts."""
    out = np.zeros(len(query))
    todo = np.arange(len(query))
    less, fewer = np.zeros(len(query)), np.zeros(len(query))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        q = query[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        node = Level.find(level.context, q >> np.uint64(8))
        have = node >= 0
        at = Level.find(level.gram, q)
        total = np.where(have, level.total[node] - less[todo], 0.0) if len(level.total) else np.zeros(len(q))
        kinds = np.where(have, level.kinds[node] - fewer[todo], 0.0) if len(level.kinds) else np.zeros(len(q))
        whole, seen = total + kinds, at >= 0
        out[todo[seen]] += np.log10(level.n[at[seen]] / whole[seen])
        # Without symbols that aren't excluded the escape is certain.
        escape = have & ~seen & (kinds > 0)
        out[todo[escape]] += np.log10(kinds[escape] / whole[escape])
        if k:
            less[todo[have]] = level.excluded(levels[k - 1], k)[node[have]]
            fewer[todo[have]] = level.kinds[node[have]]
        todo = todo[~seen]
    if len(todo):
        out[todo] -= np.log10(256 - len(levels[0].gram))
    return out


def gram_values(counts: DataFrame, order: int) -> DataFrame:
    """(kind, key, value, known, n_all) of all grams: value is the log10 probability."""
    spark = counts.sparkSession
    grams = counts.where(F.col("kind") == GRAM)
    sums = lambda k: grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
    # Contexts of LOW bytes go to all tasks if their table is small enough, else those of one byte, which are 65,536 keys at most.
    known = sums(LOW)
    depth = LOW if known.count() <= LOW_KEYS else 1
    low = (known if depth == LOW else sums(depth)).toArrow()
    by = np.argsort(low.column("key").to_numpy())
    key, n = low.column("key").to_numpy()[by].astype(np.uint64), low.column("n").to_numpy()[by].astype(np.float64)
    shared = spark.sparkContext.broadcast((key, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("key", "n", "n_all")] for b in batches]
        if not parts:
            return
        gram, n, n_all = (np.concatenate(p) for p in zip(*parts, strict=True))
        gram = gram.view(np.uint64)
        by = np.argsort(gram)
        own = by[n[by] > 0]
        levels = [Level.shorter(*shared.value, k) for k in range(min(depth, order) + 1)]
        levels += [Level.shorter(gram[own], n[own], k) for k in range(depth + 1, order + 1)]
        values = log_probabilities(gram, levels)
        for at in range(0, len(gram), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(gram[cut])), pa.array(values[cut]), pa.array(n[cut] > 0), pa.array(n_all[cut])], names=["key", "value", "known", "n_all"]
            )

    # All contexts that end in the same three bytes meet in one task; a task holds about TASK_KEYS keys.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // TASK_KEYS))
    dealt = grams.select("key", "n", "n_all").repartition(parts, F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1)))
    return dealt.mapInArrow(run, "key long, value double, known boolean, n_all long").select(F.lit(GRAM).alias("kind"), "key", "value", "known", "n_all")


def word_values(counts: DataFrame) -> tuple[DataFrame, int]:
    """(kind, key, value, known, n_all) of all words with the smoothed unigram log10 probability, and the training tokens."""
    words = counts.where(F.col("kind") == WORD)
    r = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, kinds = int(r.n or 0), int(r.v or 0)
    value = F.log10((F.col("n") + 0.1) / (total + 0.1 * (kinds + 1)))
    return words.select(F.lit(WORD).alias("kind"), "key", value.alias("value"), (F.col("n") > 0).alias("known"), "n_all"), total


class HashTable:
    """Exact key -> (value, known) table for whole arrays: each level holds the keys that met another in the level before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, known: np.ndarray):
        self.levels, multiplier = [], 0x9E3779B97F4A7C15
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(4 * len(left) - 1).bit_length())
            slot = ((keys[left] * np.uint64(multiplier)) >> np.uint64(64 - bits)).astype(np.int64)
            row = np.full(1 << bits, -1, dtype=np.int32)
            row[slot] = left
            self.levels.append((np.uint64(multiplier), np.uint64(64 - bits), row))
            left = left[row[slot] != left]
            multiplier = multiplier * 0xD1342543DE82EF95 % (1 << 64) | 1
        self.keys, self.values, self.known = keys, values, known

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted key, -1 if there is none."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        todo = None
        for multiplier, shift, row in self.levels:
            keys = wanted if todo is None else wanted[todo]
            at = row[((keys * multiplier) >> shift).astype(np.int64)]
            hit = at >= 0
            hit[hit] = self.keys[at[hit]] == keys[hit]
            if todo is None:
                out[hit], todo = at[hit], np.flatnonzero(~hit)
            else:
                out[todo[hit]], todo = at[hit], todo[~hit]
            if not len(todo):
                break
        return out


def head_of(values: DataFrame, most: int) -> tuple[HashTable, DataFrame]:
    """The most frequent keys as a table of ``most`` rows at most, and the DataFrame of all others.

    The least count of the head is a power of two, so ties never split.
    """
    level = F.floor(F.log2(F.col("n_all").cast("double"))).cast("int")
    sizes = {r.level: r.n for r in values.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    bound = F.lit(1 << min(least, 62))
    head = values.where(F.col("n_all") >= bound).select("key", "value", "known").toArrow()
    keys = head.column("key").to_numpy().view(np.uint64)
    table = HashTable(keys, head.column("value").to_numpy(), head.column("known").to_numpy())
    return table, values.where(F.col("n_all") < bound).select("kind", "key", "value", "known")


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.r_[0.0, np.cumsum(values)]
    end = np.cumsum(sizes)
    return upto[end] - upto[end - sizes]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = 10, head: int = HEAD) -> DataFrame:
    """One row per row of ``df``: the model's and the baseline's log10 probability of the text.

    Rows whose crc32 of the id as text is divisible by ``folds`` are held out of all counts.  A
    null or empty text is the end alone, and a null id counts as the empty text (held out) and is
    returned as null; repeated rows count and are scored each; an empty table gives no rows; a text
    is one task's work and held whole; without training rows every symbol has probability 1 / 256; ids
    are whole numbers; other columns are not read.
    """
    spark = df.sparkSession
    whole_numbers(df, id_col)
    bounded_batches(spark)
    out_fold = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")).cast("binary")) % folds == 0
    docs = df.select(df[id_col].cast("long").alias("doc_id"), out_fold.alias("held_out"), df[text_col].alias("text"))
    counts = materialize(corpus_counts(docs, order), "counts")
    words, train_tokens = word_values(counts)
    grams = materialize(gram_values(counts, order), "trie")
    gram_head, gram_tail = head_of(grams, head)
    word_head, word_tail = head_of(words, head)
    shared = spark.sparkContext.broadcast((gram_head, word_head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), texts_of(batch.column(2))
            for first, part in chunks(texts):
                gram, size, token, count = keys_of(part, order)
                n, rows = len(part), row + np.arange(len(part))
                sums, tails = [], []
                for kind, keys, sizes in ((GRAM, gram, size), (WORD, token, count)):
                    at = tables[kind].find(keys)
                    there = at >= 0
                    found = at[there]
                    value, known = np.zeros(len(keys)), np.zeros(len(keys))
                    value[there], known[there] = tables[kind].values[found], tables[kind].known[found]
                    sums += [_sums(value, sizes), np.rint(_sums(known, sizes)).astype(np.int64)]
                    rest = np.flatnonzero(~there)
                    tails.append((np.repeat(rows, sizes)[rest], np.full(len(rest), kind, np.int32), signed(keys[rest])))
                tail = [np.concatenate(p) for p in zip(*tails, strict=True)]
                m = len(tail[0])
                nulls = lambda k, t: pa.nulls(k, t)
                whole = lambda a, t: pa.concat_arrays([pa.array(a, t), nulls(m, t)])
                ids_, held_ = ids.slice(first, n).cast(pa.int64()), held.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, tail[0]])),
                        pa.concat_arrays([nulls(n, pa.int32()), pa.array(tail[1])]),
                        pa.concat_arrays([nulls(n, pa.int64()), pa.array(tail[2])]),
                        pa.concat_arrays([ids_, nulls(m, pa.int64())]),
                        pa.concat_arrays([held_, nulls(m, pa.bool_())]),
                        whole(count, pa.int64()), whole(sums[3], pa.int64()), whole(sums[2], pa.float64()), whole(sums[0], pa.float64()),
                    ],
                    names=["row", "kind", "key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
                row += n

    schema = "row long, kind int, key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = materialize(docs.mapInArrow(run, schema), "scored")
    # Rare keys: each is counted per row first, then joined with its value.
    rare = scored.where("kind is not null").groupBy("row", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("kind") == WORD
    valued = rare.join(gram_tail.union(word_tail), ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(is_word & F.col("known"), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.when(is_word, F.col("n") * F.col("value")).otherwise(0.0)).alias("tail_base"),
        F.sum(F.when(~is_word, F.col("n") * F.col("value")).otherwise(0.0)).alias("tail_score"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.where("kind is null").join(valued, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "tail_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        plus("base_score", "tail_base"), plus("score", "tail_score"),
    )
