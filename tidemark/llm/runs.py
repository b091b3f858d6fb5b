"""Periodic runs in documents: stretches of words that repeat with a period.

The words of a document get numbers, and the numbers' bits become planes, big integers with one
bit a word.  For each lag the planes are XORed with themselves shifted and the mismatches ORed;
shift-doubling ANDs leave the starts of stretches without a mismatch that are long enough.
A stretch found under a smaller lag already has a smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, texts_of

#: A run repeats its period so often, and has so many words at least.
REPEATS, LEAST = 4, 6
#: Lags above this one are looked at only if words so far apart are alike at several multiples of the lag in a row.
SIEVED = 64


def long_ones(bits: int, length: int) -> int:
    """Bit i is set where the ``length`` bits from i on are set."""
    have = 1
    while bits and have < length:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits


def stretches(bits: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, end) of all maximal stretches of ``length`` or more set bits."""
    found = long_ones(bits, length)
    while found:
        low = (found & -found).bit_length() - 1
        rest = found >> low
        n = (~rest & (rest + 1)).bit_length() - 1
        yield low, low + n + length - 1
        found = (rest >> n) << (low + n)


def planes_of(ids: np.ndarray) -> list[int]:
    """Plane j has bit i set where number i has its bit j set."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> j & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for j in range(width)]


def _meets(ids: np.ndarray, lag: int, equal: int, known: np.ndarray) -> bool:
    """Whether words ``lag`` apart are alike at ``equal`` multiples of the lag in a row, outside known runs that the lag is a multiple of.

    A stretch of ``equal * lag`` matches holds so many multiples.  One that meets a known run of a
    divisor of the lag over so many words has that run's period, so it is no run of this lag.
    """
    sample = ids[::lag]
    same = sample[1:] == sample[:-1]
    if len(same) < equal:
        return False
    hit = same[equal - 1 :].copy()
    for j in range(equal - 1):
        hit &= same[j : len(same) - equal + 1 + j]
    at = np.flatnonzero(hit) * lag
    if not len(at):
        return False
    inside = known[lag % known[:, 2] == 0] if len(known) else known
    for start, end, _ in inside[inside[:, 1] - inside[:, 0] >= equal * lag].tolist() if len(inside) else ():
        at = at[(at < start) | (at + equal * lag >= end)]
    return len(at) > 0


def periodic_runs(words: list, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period: ``max(least, repeats * period)`` words or more, no smaller period, not extendable."""
    names: dict = {}
    n = len(words)
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    planes, known, out = planes_of(ids), {}, []
    table = np.zeros((0, 3), np.int64)
    for lag in range(1, n // repeats + 1):
        need = max(least, repeats * lag) - lag
        if lag > SIEVED:
            if len(table) < len(out):
                table = np.array([(s, s + k, q) for s, k, q in out], np.int64)
            if not _meets(ids, lag, repeats - 1, table):
                continue
        full = (1 << (n - lag)) - 1
        differ = 0
        for i, plane in enumerate(planes):
            differ |= plane ^ (plane >> lag)
            # Where a few planes already leave no stretch, the others can't bring one back.
            if i & 3 == 3 and not long_ones(~differ & full, need):
                break
        else:
            for start, end in stretches(~differ & full, need):
                length = end - start + lag
                if known.setdefault((start, length), lag) == lag:
                    out.append((start, length, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of the greatest exact length over period; ties by smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside all runs, and of each run its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """One row per row of ``df``: its id, n_words, runs, best and the collapsed text.

    ``runs`` has (start, length, period) of each run, by start, then period; ``best`` is the run of
    the greatest exact length over period (null without runs); ``collapsed`` joins by one space the
    words that no run holds after its first period.  Words stand between ASCII white space and are
    compared exactly.  A null or blank text has no words; ids of any type, null and repeated ones
    too, are passed through; other columns are not read; a very long text is one task's
    work, of about n log n steps beside its runs.
    """
    bounded_batches(df.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def named(r: tuple[int, int, int] | None) -> dict | None:
        return r and dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch.column(1))]
            runs = [periodic_runs(w, repeats, least) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[named(r) for r in found] for found in runs], pa.list_(run_type)),
                    pa.array([named(best_run(found)) for found in runs], run_type),
                    pa.array([b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    one = "struct<start: bigint, length: bigint, period: bigint>"
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<{one}>, best {one}, collapsed string"
    )
