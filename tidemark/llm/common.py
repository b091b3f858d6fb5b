"""Helpers shared by the operators: shared folders, hand-over tables, small text kernels."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

#: Largest Arrow batch handed to Python; long texts then never pile up in one batch.
BATCH_BYTES = 4 << 20

#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs in one process (tests, a laptop) a local folder
    is made and remembered; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(*frames: DataFrame) -> None:
    """Delete the files behind tables of :func:`materialize` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the machine at the end of a task, as its worker lives on beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps so much that this pays
    if trim:
        trim(0)


def whole_numbers(df: DataFrame, *columns: str) -> None:
    """Refuse ids that aren't whole numbers before any task runs."""
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"column {c} must hold whole numbers, not {kind.simpleString()}")


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S)
    h = h * _M
    h = h ^ (h >> _S)
    h = h * _M2
    return h ^ (h >> _S)


_rng = np.random.default_rng(20240229)
#: Random 64-bit value of each byte and an odd base, for polynomial hashes of byte runs.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``data[start:end]``; equal runs have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * _power(n, "up", _BASE)[:n], out=total[1:])
    down = _power(n, "down", pow(_BASE, -1, 1 << 64))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: A-Z in lower case; every ASCII byte that is no letter or digit a space; other bytes as they are.
WORD_BYTES = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def hashed_words(texts: list[str], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space words of the texts, mapped by ``table``, and each text's number of words."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = [t.encode("utf-8", "surrogatepass").translate(table) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, bounds, side="left")
    return span_hashes(data, start, end), np.diff(upto, prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words inside each text (fewer words: the whole text), and each text's number of them."""
    n = len(words)
    size = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    if not n:
        return words, size
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.zeros(n, dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    left = np.repeat(first + counts, counts) - np.arange(n)
    for j in range(k):
        w = np.zeros(n, dtype=np.uint64)
        w[: n - j] = words[j:] if j else words
        ok = left > j
        h = np.where(ok, mix(h * odd + w + np.uint64(j + 1)), h)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    return h[at], size


def slices(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive runs of ``values`` of the given sizes."""
    at = 0
    for n in sizes.tolist():
        yield values[at : at + n]
        at += n


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark longs."""
    return h.view(np.int64)
