"""Training-order materialisation: every sequence gets a global slot, and slots lie in fixed-stride shards.

Documents are tokenised once into sequences of ``window`` ids, staged in the shared folder and
numbered densely.  A keyed Feistel permutation with cycle-walking maps number to slot, so the
order is random, needs no sort by random keys and can be computed for any slot alone.  Sequences
are dealt to shards by slot range, and a shard is a file of ``per_shard`` records of ``width *
window`` bytes, an id being ``width`` bytes (2 if the vocabulary allows, else 4): slot s is at byte
``(s % per_shard) * width * window`` of shard ``s // per_shard``, which is all that a reader needs
to start or resume.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix, new_path, remove_tables, texts_of, whole_numbers
from .packing import default_tokenizer, encoder

WINDOW = 1024
#: Sequences of a shard: files of 8 MB at a window of 1024.
PER_SHARD = 4096
ROUNDS = 4
#: Staged ids are read twice at most, so they are packed densely.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
#: Staged sequences that are shared as a compression dictionary: 256 KB.
DICTIONARY_ROWS = 128
#: Id that fills the last sequence of a task, and the id after each document.
PAD = END = 0
SCHEMA = "slot long, sequence long, shard long, shard_offset long, n_tokens long, n_pad long, first_doc_id long, ids_crc32 long, path string"


def _dictionary(words: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None


def feistel(x: np.ndarray, bits: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of the numbers below 2 ** (2 * bits): ``ROUNDS`` rounds over two halves."""
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left, right = x >> half, x & mask
    for k in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << half) | right


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: numbers that fall outside walk on along their cycle."""
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    out = feistel(np.asarray(x, dtype=np.uint64), bits, key, inverse)
    while (far := out >= n).any():
        out[far] = feistel(out[far], bits, key, inverse)
    return out.astype(np.int64)


def id_width(tokenizer: str) -> int:
    """Bytes of an id: 2 where the vocabulary allows, else 4."""
    return 2 if encoder(tokenizer).most <= 0xFFFF else 4


def tokenise(df: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int) -> DataFrame:
    """(part, local, n_tokens, first_doc_id, ids): each task's documents end to end, cut into windows."""
    cell = f"<u{id_width(tokenizer)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, owners, size, local = [], [], 0, 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, owners, size, local
            ids = np.concatenate(held) if held else np.zeros(0, cell)
            starts = np.cumsum([0, *map(len, held)])
            n = -(-len(ids) // window) if last else len(ids) // window
            used = min(len(ids), n * window)
            cells = np.full(n * window, PAD, dtype=cell)
            cells[:used] = ids[:used]
            at = np.searchsorted(starts, np.arange(n) * window, side="right") - 1
            first = [owners[i] for i in at.tolist()]
            counts = np.minimum(window, used - np.arange(n) * window)
            rows = [cells[i * window : (i + 1) * window].tobytes() for i in range(n)]
            number = local + np.arange(n)
            local, held, size = local + n, [ids[used:]] if used < len(ids) else [], len(ids) - used
            owners = owners[-1:] if held else []
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int64)), pa.array(number.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(first, pa.int64()), pa.array(rows, pa.binary())],
                names=["part", "local", "n_tokens", "first_doc_id", "ids"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                held.append(np.append(encode(text), END).astype(cell))
                owners.append(doc)
                size += len(held[-1])
                if size >= 512 * window:
                    yield emit(last=False)
        yield emit(last=True)

    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return docs.mapInArrow(run, "part long, local long, n_tokens long, first_doc_id long, ids binary")


def write_shards(
    df: DataFrame, folder: str, key: int = 42, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str | None = None, window: int = WINDOW, per_shard: int = PER_SHARD,
) -> DataFrame:
    """Write the shards and return their index, a row per sequence: slot, shard, byte offset, checksum, file.

    A null or empty text is the end id alone; a null id is kept as null; repeated rows are written
    each; an empty table gives no shards; other columns are not read; a very long text is held by one
    task and cut into sequences; ids must be integers.  Each task pads its last
    sequence.  A shard is written under a name of its own and moved into place when whole, so a
    lost or repeated task leaves no partial shard; the index names the file that counts.
    """
    bounded_batches(df.sparkSession)
    whole_numbers(df, id_col)
    tokenizer = tokenizer or default_tokenizer()
    stride = id_width(tokenizer) * window
    staged = materialize(tokenise(df, id_col, text_col, tokenizer, window), "sequences", **DENSE)
    # A row per task of the tokeniser: the number of its sequences.
    sizes = {r.part: r.n for r in staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = np.array(sorted(sizes), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum([sizes[p] for p in parts.tolist()])]).astype(np.int64)
    total = int(before[-1])

    # Sequences travel compressed; a few of them are the dictionary that makes short records shrink.
    words = b"".join(r.ids for r in staged.select("ids").limit(DICTIONARY_ROWS).collect())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6, dict_data=_dictionary(words))
        for batch in batches:
            part, local = (batch.column(c).to_numpy() for c in ("part", "local"))
            sequence = before[np.searchsorted(parts, part)] + local
            slot = permute(sequence, total, key)
            ids = pa.array([packer.compress(i) for i in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard), pa.array(slot), pa.array(sequence), *(batch.column(c) for c in ("n_tokens", "first_doc_id")), ids],
                names=["shard", "slot", "sequence", "n_tokens", "first_doc_id", "ids"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
        shard = out = None
        rows: list[tuple] = []
        name = ""

        def close() -> pa.RecordBatch:
            nonlocal rows, out
            final = f"shard-{shard:08d}.bin"
            if out is not None:
                out.close()
                store.move(f"{root}/{name}", f"{root}/{final}")
                out = None
            columns = list(zip(*(r + (f"{folder}/{final}",) for r in rows), strict=True)) if rows else [[]] * 9
            rows = []
            fields = [f.split() for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

        for batch in batches:
            for s, slot, sequence, n, doc, ids in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if s != shard:
                    if out is not None:
                        yield close()
                    shard, name = s, f".shard-{s:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                ids = unpacker.decompress(ids)
                out.write(ids)
                rows.append((slot, sequence, s, slot % per_shard * stride, n, window - n, doc, zlib.crc32(ids)))
        if out is not None:
            yield close()

    shards = max(1, -(-total // per_shard))
    slots = staged.mapInArrow(number, "shard long, slot long, sequence long, n_tokens long, first_doc_id long, ids binary")
    # The shard is the partition (or shares one, in very large outputs): no sampling, no second pass over the sequences.
    tasks = min(shards, 1 << 15)
    dealt = slots.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "slot")
    index = materialize(dealt.mapInArrow(write, SCHEMA), "index")
    remove_tables(staged)
    return index


def read_slots(index: DataFrame, first: int = 0, last: int | None = None, window: int = WINDOW, width: int = 2) -> DataFrame:
    """(slot, ids) of a range of slots, each shard's run read with one seek: how a run resumes; ``width`` as :func:`id_width` says."""
    wanted = index.where((F.col("slot") >= first) & (F.lit(last is None) | (F.col("slot") < F.lit(last))))
    runs = wanted.groupBy("path").agg(F.min("slot").alias("slot"), F.min("shard_offset").alias("at"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, slot, at, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    f.seek(at)
                    cells = np.frombuffer(f.read(n * width * window), dtype=f"<u{width}").reshape(n, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(slot, slot + n)), pa.array(list(cells.astype(np.int64)), pa.list_(pa.int64()))], names=["slot", "ids"]
                )

    return runs.mapInArrow(run, "slot long, ids array<long>")


def materialise(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    """:func:`write_shards` into a new folder beside the other shared tables."""
    return write_shards(df, new_path(spark, "shards"), **options)
