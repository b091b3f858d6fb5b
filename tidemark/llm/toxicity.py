"""Toxicity by class-conditional Kneser-Ney models.

An expression is a lower-cased word.  Each class has a Kneser-Ney model of words as runs of
bytes: the distribution of the next byte after a word's whole beginning comes from the class's
own counts, with absolute discounting, and backs off to counts that the classes share: continuation
counts of up to ``ORDER`` bytes of both classes together.  So an expression that one class has
hardly seen costs both about the same, and only what one class says more often speaks for it.
A toxic document says toxic expressions now and then among ordinary ones: its likelihood
interpolates the toxic class's with the ordinary one, with a weight of ``TOXIC_SHARE``.  A document's evidence is
the logarithm of that likelihood over the ordinary one, divided by its number of words; the score is a logistic
link that rises with it, fitted on ratios from models that have not seen the document.

Models are fitted on a sample of the labelled rows that is bounded by ``SAMPLE`` documents and ``SAMPLE_BYTES`` of text a class
(all of them, where there are fewer), so their size is bounded; scoring is one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, bounded_batches, materialize, release, remove_tables, span_hashes, texts_of, whole_numbers

#: Labelled documents of each class that are learned from, at most (in expectation: chosen by hash).
SAMPLE = 3000
#: Bytes of those documents' texts of each class, at most; a text that would pass the bound is left out as a whole.
SAMPLE_BYTES = 12 << 20
#: Bytes of a shared backoff context, and the discount.
ORDER, DISCOUNT = 5, 0.75
#: Share of a toxic document's words that the toxic class says; the others come from the ordinary one.
TOXIC_SHARE = 0.01
#: Words whose ratios a task remembers.
REMEMBERED = 1 << 18
#: Words that are counted at once.
BLOCK_WORDS = 1 << 15
#: Bytes of words whose ratios are found at once, and of texts whose words are; a longer word or text is taken alone.
RATIO_BYTES, PIECE_BYTES = 1 << 17, 1 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_words long, log_ratio double, strongest string"


class Spans(NamedTuple):
    """All places of " word word ... " where a byte after a word's beginning is predicted."""

    data: np.ndarray
    word: np.ndarray
    at: np.ndarray
    start: np.ndarray


def spans(words: list[bytes]) -> Spans:
    """Each word as a space, its bytes, and the space that ends it."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), size)
    return Spans(data, word, np.arange(1, len(data)), np.repeat(np.cumsum(size) - size, size))


class Table(NamedTuple):
    """Sorted keys with columns of values, found by binary search; a key that isn't there has zeros."""

    keys: np.ndarray
    values: tuple[np.ndarray, ...]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys), np.float32) for _ in self.values]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return [np.where(self.keys[place] == keys, v[place], np.float32(0)) for v in self.values]


class Counts(NamedTuple):
    """Grams with their counts, and contexts with their counts and kinds of next byte."""

    grams: Table
    contexts: Table

    @staticmethod
    def of(context: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Counts:
        g, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        count = np.bincount(inverse, n, len(g))
        c, of = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(of, count, len(c)), np.bincount(of, minlength=len(c))
        f = np.float32
        return Counts(Table(g, (count.astype(f),)), Table(c, (total.astype(f), kinds.astype(f))))

    def smooth(self, context: np.ndarray, gram: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Discounted probabilities of the grams' last bytes, interpolated with those ``below``; unseen contexts leave them."""
        total, kinds = self.contexts.get(context)
        seen = total > 0
        out = below.copy()
        have = self.grams.get(gram)[0][seen]
        out[seen] = (np.maximum(have - DISCOUNT, 0) + DISCOUNT * kinds[seen] * below[seen]) / total[seen]
        return out


class Model(NamedTuple):
    """Counts of word beginnings by class (toxic, ordinary), and shared ones of the backoff orders, the longest first."""

    own: tuple[Counts, Counts]
    shared: tuple[Counts, ...]


def _at(s: Spans, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each place's last ``k`` bytes inside its word (its whole beginning), and of the same with the predicted byte."""
    begin = s.start if k is None else np.maximum(s.at - k, s.start)
    return span_hashes(s.data, begin, s.at), span_hashes(s.data, begin, s.at + 1)


def fit(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The models of distinct words that occurred so often in toxic and ordinary documents.

    Words go through in sorted blocks, where their beginnings are counted once for all words that
    share them, so what is held grows with the distinct beginnings.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    own: list[tuple[np.ndarray, ...]] = []
    backoff: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER + 1)]
    for at in range(0, len(order), BLOCK_WORDS):
        block = order[at : at + BLOCK_WORDS]
        s = spans([words[i] for i in block])
        context, gram = _at(s)
        g, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        own.append((context[first], g, *(np.bincount(inverse, n[block][s.word], len(g)) for n in (toxic, ordinary))))
        # Continuation counts: a gram of the backoff counts once for each beginning of a word that it ends, in either class.
        kinds = s._replace(at=s.at[first], start=s.start[first])
        for k in range(ORDER + 1):
            context, gram = _at(kinds, k)
            g, one, n = np.unique(gram, return_index=True, return_counts=True)
            backoff[k].append((context[one], g, n))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    context, gram, t, o = (np.concatenate(p) for p in zip(*(own or [none]), strict=True))
    classes = (Counts.of(context[n > 0], gram[n > 0], n[n > 0]) for n in (t, o))
    shared = (Counts.of(*(np.concatenate(p) for p in zip(*(b or [none[:3]]), strict=True))) for b in reversed(backoff))
    return Model(tuple(classes), tuple(shared))


def runs_of(items: list, limit: int) -> Iterator[list]:
    """The items in order, in runs whose lengths add up to ``limit`` at most; a longer item is a run of its own."""
    first, size = 0, 0
    for i, x in enumerate(items):
        if i > first and size + len(x) > limit:
            yield items[first:i]
            first, size = i, 0
        size += len(x)
    if first < len(items):
        yield items[first:]


def log_ratios(model: Model, words: list[bytes]) -> np.ndarray:
    """Each word's log-likelihood in a toxic document less that in an ordinary one."""
    return np.concatenate([np.zeros(0), *(_log_ratios(model, run) for run in runs_of(words, RATIO_BYTES))])


def _log_ratios(model: Model, words: list[bytes]) -> np.ndarray:
    s = spans(words)
    p = np.full(len(s.at), 1 / 257)
    for k, counts in enumerate(reversed(model.shared)):
        p = counts.smooth(*_at(s, k), p)
    whole = _at(s)
    toxic, ordinary = (np.bincount(s.word, np.log(c.smooth(*whole, p)), len(words)) for c in model.own)
    return np.logaddexp(np.log1p(-TOXIC_SHARE), np.log(TOXIC_SHARE) + toxic - ordinary)


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Ratios:
    """:func:`log_ratios` of one task, with the words of earlier batches remembered up to a bound."""

    def __init__(self, model: Model, limit: int = REMEMBERED):
        self.model, self.limit, self.known = model, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, words
        self.known.update(zip(new, log_ratios(self.model, new).tolist(), strict=True))
        return np.fromiter((self.known[w] for w in words), float, len(words))


def evidence(ratios: Ratios, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Per text: number of words, log-likelihood ratio a word (0 without words), and the word that speaks most for toxic."""
    found = [_evidence(ratios, run) for run in runs_of(texts, PIECE_BYTES)]
    n, mean = (np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.int64, float)))
    return n, mean, [w for f in found for w in f[2]]


def _evidence(ratios: Ratios, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    known: dict[bytes, int] = {}
    rows = [np.fromiter((known.setdefault(w, len(known)) for w in split(t)), np.int64) for t in texts]
    words = list(known)
    ratio = ratios(words)
    mean = np.array([ratio[w].mean() if len(w) else 0.0 for w in rows])
    strongest = [words[w[np.argmax(ratio[w])]] if len(w) else None for w in rows]
    return np.array([len(w) for w in rows], np.int64), mean, strongest


class Link(NamedTuple):
    """A logistic link that rises with the ratio a word."""

    weight: float
    bias: float

    @staticmethod
    def scaled(mean: np.ndarray) -> np.ndarray:
        """From 0, at the least ratio a word, in steps of the logarithm."""
        return np.log1p(np.maximum(mean - np.log1p(-TOXIC_SHARE), 0) / TOXIC_SHARE)

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weight * self.scaled(mean) + self.bias, -35, 35)))


def fit_link(mean: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> Link:
    """Logistic regression by Newton steps; the rows' weights restore the classes' shares; the weight never falls under 0."""
    a, pen = np.c_[Link.scaled(mean), np.ones(len(mean))], ridge * np.ones(2)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (w * (y - p)) - pen * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    if beta[0] >= 0:
        return Link(float(beta[0]), float(beta[1]))
    rate = np.clip(np.average(y, weights=w), 0.01, 0.99)
    return Link(0.0, float(np.log(rate / (1 - rate))))


def held_out(id_col: str, folds: int = 5):
    """crc32 of the id as text falls on 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_counts(df: DataFrame) -> DataFrame:
    """(word, half, toxic, n): words of the labelled documents (toxic, half, text), counted in tasks before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, int], dict[bytes, int]] = {}
            for toxic, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                c = counts.setdefault((half, toxic), {})
                for w in split(text):
                    c[w] = c.get(w, 0) + 1
            for (half, toxic), c in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.binary()), pa.array([half] * len(c), pa.int32()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                    names=["word", "half", "toxic", "n"],
                )

    return df.mapInArrow(run, "word binary, half int, toxic int, n long").groupBy("word", "half", "toxic").agg(F.sum("n").alias("n"))


class Classifier(NamedTuple):
    model: Model
    link: Link


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> Classifier:
    """Fit on the labelled rows outside the held-out fold; of a document's several labels the highest counts.

    Without rows of both classes the score is the share of toxic rows, or 0.5 without any (an empty
    table).  Labels that are null or not 0 or 1, and null ids, are not learned from; a null text has no words;
    documents that repeat an id are learned from each; other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {c: min(1.0, sample / max(sizes.get(c, 0), 1)) for c in (0, 1)}
    kept = own.where(place < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    kept = kept.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    drawn = materialize(docs.join(F.broadcast(kept), "doc_id"), "sample")
    # About 2 * sample rows of numbers, in an order that no text decides.
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")
    found = drawn.groupBy("doc_id", "toxic", "half").agg(size).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    used, chosen = {0: 0, 1: 0}, []
    for i, c, n in zip(*(found.column(c).to_pylist() for c in ("doc_id", "toxic", "size")), strict=True):
        if used[c] + n <= sample_bytes:
            used[c] += n
            chosen.append((i,))
    within = spark.createDataFrame(chosen, drawn.select("doc_id").schema)
    learn = drawn.join(F.broadcast(within), "doc_id").select("toxic", "half", "text")
    counts = word_counts(learn).toArrow()
    words = counts.column("word").combine_chunks().dictionary_encode()
    if counts.num_rows and isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    names = words.dictionary.to_pylist() if counts.num_rows else []
    index = words.indices.to_numpy() if counts.num_rows else np.zeros(0, np.int64)
    half, toxic, n = (counts.column(c).to_numpy() for c in ("half", "toxic", "n"))
    total = {(h, c): np.bincount(index[(half == h) & (toxic == c)], n[(half == h) & (toxic == c)], len(names)) for h in (0, 1) for c in (0, 1)}

    def model(halves: tuple[int, ...]) -> Model:
        t, o = (sum(total[h, c] for h in halves) for c in (1, 0))
        used = np.flatnonzero(t + o)
        return fit([names[i] for i in used.tolist()], t[used], o[used])

    # Ratios for the link come from the half that the document isn't in.
    other = spark.sparkContext.broadcast((model((1,)), model((0,))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = [Ratios(m) for m in other.value]
        for batch in batches:
            toxic, half, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                _, mean, _ = evidence(ratios[h], [texts[i] for i in at.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at]), pa.array(mean)], names=["toxic", "x"])

    rows = learn.mapInArrow(run, "toxic int, x double").toArrow()
    other.destroy()
    remove_tables(drawn)
    y, x = rows.column("toxic").to_numpy().astype(float), rows.column("x").to_numpy()
    if len(set(y.tolist())) < 2:
        rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        link = Link(0.0, float(np.log(rate / (1 - rate))))
    else:
        # A row stands for as many as its class has, over those that were learned from.
        link = fit_link(x, y, np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum())) * len(y) / (sizes[0] + sizes[1]))
    return Classifier(model((0, 1)), link)


def score(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: score (0 to 1), decision at 0.5, and the evidence.

    A null or wordless text scores as one without evidence; repeated rows are scored each; a null
    id is held out and returned as null; an empty table gives no rows; a very long text is one row's work and held whole;
    no column but the text enters the score, and columns of any other name are not read.  Ids are whole numbers.
    """
    whole_numbers(df, id_col)
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, link = shared.value
        ratios = Ratios(model)
        for batch in batches:
            n, mean, strongest = evidence(ratios, texts_of(batch.column(2)))
            p = link.score(mean)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n),
                 pa.array(mean), pa.array([None if w is None else w.decode("utf-8", "replace") for w in strongest], pa.string())],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_clean(df: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score under the threshold, columns unchanged.

    A null or wordless text scores as one without evidence; repeated rows stay or go each alike;
    an empty table stays empty.
    """
    shared, at = df.sparkSession.sparkContext.broadcast(classifier), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, link = shared.value
        ratios = Ratios(model)
        for batch in batches:
            _, mean, _ = evidence(ratios, texts_of(batch.column(at)))
            yield batch.filter(pa.array(link.score(mean) < threshold))
        del ratios, model
        release()

    return df.mapInArrow(run, df.schema)
