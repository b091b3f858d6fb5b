"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction.

The sketch of a union of documents is the union of their sketches, and containment is estimated
from the hashes two sketches share, however unequal the documents.  A fingerprint's head holds
the number and the sum of all distinct shingle hashes, so that documents too short to keep a
hash still compare as equal or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hashed_words, shingle_hashes, slices, texts_of, whole_numbers

#: Words of a shingle, and the kept share of the hash range.
SHINGLE, FRACTION = 5, 0.25
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "jaccard_edited double, jaccard_next double"
)
_LOWEST = -(1 << 63)


def sketches(texts: list[str], k: int = SHINGLE, fraction: float = FRACTION) -> list[tuple[tuple[int, int], np.ndarray]]:
    """Each text's head (number and sum of distinct hashes) and its kept hashes in order."""
    limit, out = np.uint64(int(fraction * (1 << 64))), []
    for h in slices(*shingle_hashes(*hashed_words(texts), k)):
        u = np.unique(h)
        out.append(((len(u), int(u.sum(dtype=np.uint64))), u[: np.searchsorted(u, limit)]))
    return out


def written(sketch: tuple[tuple[int, int], np.ndarray]) -> str:
    """The fingerprint as text: number, sum, and the kept hashes in hexadecimal."""
    (n, total), kept = sketch
    return f"{n:x}.{total:016x}." + kept.astype(">u8").tobytes().hex()


def likeness(a: tuple, b: tuple) -> tuple[float, float]:
    """(containment of the smaller in the larger, Jaccard) as the sketches estimate them, each 0 to 1.

    Where a sketch has kept no hash, only equal documents are alike.
    """
    if a[0] == b[0]:
        return 1.0, 1.0
    least = min(len(a[1]), len(b[1]))
    if not least:
        return 0.0, 0.0
    both = len(np.intersect1d(a[1], b[1], assume_unique=True))
    return both / least, both / (len(a[1]) + len(b[1]) - both)


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_shingles, hashes): one row per row, for joins and merges; a null text has no hashes; ids are whole numbers."""
    whole_numbers(df, id_col)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(texts_of(batch.column(1)), k, fraction)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([s[0][0] for s in made], pa.int64()), pa.array([s[1].view(np.int64) for s in made], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "hashes"],
            )

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, hashes array<long>")


def merge(sketched: DataFrame, by: str) -> DataFrame:
    """(by, hashes): sketches of the groups' unions."""
    one = sketched.select(by, F.explode("hashes").alias("h")).distinct()
    return one.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, guest, id, text) whose order by all of these puts each row before its successor in descending id.

    Ids are cut into ranges of nearly equal numbers; a range's highest rows are guests at the end
    of the range above (of the lowest range for the highest), so each range holds its last row's
    successor and no text goes through the driver or a single task.
    """
    spark = df.sparkSession
    ids = df.select(F.coalesce(df[id_col].cast("long"), F.lit(_LOWEST)).alias("id"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("c")).first().c or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, s.to_numpy(), side="left").astype(np.int32))

    tops = {r.b: r.top for r in ids.select("id", bucket("id").alias("b")).groupBy("b").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    host = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(s: pd.Series) -> pd.Series:
        """The row's range, and as -1 - range the one where it is a guest."""
        own = np.searchsorted(cuts, s.to_numpy(), side="left").tolist()
        return pd.Series([[b, -1 - host[i]] if i in host else [b] for b, i in zip(own, s.tolist(), strict=True)])

    rows = df.select(
        F.coalesce(df[id_col].cast("long"), F.lit(_LOWEST)).alias("id"), df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text")
    )
    return rows.withColumn("p", F.explode(places("id"))).select(
        F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("bucket"), (F.col("p") < 0).alias("guest"), "id", "doc_id", "text"
    )


def next_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """One row per row of ``df``: its fingerprint against those of its edited text and of the next document.

    The next document is that of the next lower id, after the lowest that of the highest; the
    edited text replaces the last half of the code points by the next document's first as many.
    A null text is empty and a null id comes after all others; rows that repeat an id follow one
    another by text; a single row is its own successor; ids are whole numbers; other columns are not read.
    """
    spark = df.sparkSession
    whole_numbers(df, id_col)
    bounded_batches(spark)
    spread = with_next(df, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), F.xxhash64("text"))
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True))
            rows = rows if before is None else [before, *rows]
            before = rows[-1]
            texts = [r[3] for r in rows]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
            own, changed = sketches(texts, k, fraction), sketches(edited, k, fraction)
            out = []
            for i, e in enumerate(edited):
                a, b = rows[i], rows[i + 1]
                if a[1] or a[0] != b[0]:
                    continue
                (c1, j1), (c2, j2) = likeness(own[i], changed[i]), likeness(own[i], own[i + 1])
                sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((a[2], len(a[3]), sha, written(own[i]), written(changed[i]), c1, c2, j1, j2))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(run, SCHEMA)
