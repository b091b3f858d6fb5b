"""Hierarchical multi-length packing of tokenised documents.

Documents go to tiers of context sizes by length; each tier's windows are packed, the gaps of
long windows are filled from shorter tiers (cutting the last piece to fit), and the finished
windows are dealt to step groups of nearly equal numbers of tokens.  One pass over the input, no
shuffle: a task packs what it reads, in pools of bounded size, so a hot source or a very long
text changes nothing.  A task pads at most its last window.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, release, texts_of, whole_numbers

WINDOW = 1024
TIERS = (128, 256, 512, 1024)
#: Tokens that a task holds before it packs them.
POOL_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space as the tokeniser's pattern has it, and the length from which a run of it is set apart.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK_RUN = 64


@functools.lru_cache(2)
def encoder(path: str, blank_run: int = BLANK_RUN):
    """text -> uint32 ids of the byte-level BPE in the tokenizers file at ``path``.

    The file's vocabulary is read as merge ranks (its ids are in merge order), which gives the
    ids of the tokenizers library at several times its speed; tests compare the two.  The file's
    added tokens are cut out of a text first and are their own ids.  The pattern's search takes time
    quadratic in the length of white space, and overflows its stack in the end: of a run of ``blank_run`` or more all but the
    last character (at a text's end: all) are one piece by the pattern, and are merged as one.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = spec.get("added_tokens", [])
    if any(t.get(f) for t in added for f in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    by_pattern, whole = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, "(?s).+"))
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    blanks = re.compile(f"{_BLANK}{{{blank_run},}}")

    def plain(text: str) -> list[int]:
        if len(text) < blank_run:
            return by_pattern.encode_ordinary(text)
        out, at = [], 0
        for m in blanks.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += by_pattern.encode_ordinary(text[at : m.start()]) + whole.encode_ordinary(text[m.start() : end])
            at = end
        return out + by_pattern.encode_ordinary(text[at:])

    def encode(text: str) -> np.ndarray:
        if cut is None or not any(t in text for t in special):
            return np.asarray(plain(text), dtype=np.uint32)
        parts = (([special[p]] if p in special else plain(p)) for p in cut.split(text))
        return np.fromiter(itertools.chain.from_iterable(parts), np.uint32)

    encode.most = max([*ranks.values(), *special.values()], default=0)
    return encode


class _Packer:
    """Packs the documents of one task: whole windows at once, the rest through tiers."""

    def __init__(self, part: int, window: int, tiers: tuple[int, ...], step_tokens: int):
        self.window, self.tiers, self.step_tokens = window, sorted({*tiers, window}), step_tokens
        self.items: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (length, number, start)
        self.docs: dict[int, tuple[object, np.ndarray]] = {}
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.number = self.tokens = 0
        self.sequence = self.group = part << 33  # a task's numbers never meet another's

    def document(self, doc: object, ids: np.ndarray) -> None:
        self.docs[self.number] = (doc, ids)
        full = len(ids) // self.window * self.window
        self.done += [(self.window, [(self.window, self.number, k)]) for k in range(0, full, self.window)]
        if len(ids) > full:
            self.route(len(ids) - full, self.number, full)
        self.number += 1
        self.tokens += len(ids)

    def route(self, length: int, number: int, start: int) -> None:
        insort(self.items[self.tiers[bisect_left(self.tiers, length)]], (length, number, start))

    def fitting(self, gap: int, tier: int) -> tuple[int, int, int] | None:
        """The longest item that fits the gap, from the window's tier or a shorter one."""
        for t in reversed(self.tiers):
            if t <= tier and (at := bisect_left(self.items[t], (gap + 1,))):
                return self.items[t].pop(at - 1)
        return None

    def cut(self, gap: int) -> tuple[int, int, int] | None:
        """The first ``gap`` tokens of the shortest item left; its rest is routed again."""
        items = next((self.items[t] for t in self.tiers if self.items[t]), None)
        if items is None:
            return None
        length, number, start = items.pop(0)
        self.route(length - gap, number, start + gap)
        return gap, number, start

    def fill(self, last: bool) -> None:
        """Fill windows from the longest tier down; a window that can't be filled waits, or ends the task."""
        for tier in reversed(self.tiers):
            while self.items[tier]:
                pieces, gap = [], tier
                while gap and (piece := self.fitting(gap, tier) or self.cut(gap)):
                    pieces.append(piece)
                    gap -= piece[0]
                if gap and not last:
                    for piece in pieces:
                        self.route(*piece)
                    return
                self.done.append((tier, pieces))

    def flush(self, last: bool) -> pa.RecordBatch:
        self.fill(last)
        groups = max(1, round(sum(p[0] for _, pieces in self.done for p in pieces) / self.step_tokens))
        load, rows = [(0, g) for g in range(groups)], []
        for tier, pieces in sorted(self.done, key=lambda w: -w[0]):
            tokens, g = heapq.heappop(load)
            offset = 0
            for length, number, start in pieces:
                doc, ids = self.docs[number]
                crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                rows.append((doc, start, length, crc, len(ids), self.sequence, offset, tier, self.group + g))
                offset += length
            self.sequence += 1
            heapq.heappush(load, (tokens + offset, g))
        self.group += groups
        self.done = []
        waiting = {number for items in self.items.values() for _, number, _ in items}
        self.docs = {n: d for n, d in self.docs.items() if n in waiting}
        self.tokens = sum(length for items in self.items.values() for length, _, _ in items)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    pool_tokens: int = POOL_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where its ids lie in which sequence.

    A document is its token ids and then id 0; a null or empty text is id 0 alone.  A null id
    stays null, repeated rows are packed each for itself, an empty table gives no rows, and other
    columns of ``df`` are neither read nor returned; a very long text is cut into whole windows at once.
    ``tier`` is the window's size and ``step_group`` the training step that it is dealt to; groups are
    balanced among the windows of one pool of a task.  Ids must be integers.
    """
    path = tokenizer or default_tokenizer()
    bounded_batches(df.sparkSession)
    whole_numbers(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = _Packer(TaskContext.get().partitionId(), window, tiers, step_tokens)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                packer.document(doc, np.append(encode(text), np.uint32(0)))
                if packer.tokens >= pool_tokens:
                    yield packer.flush(last=False)
        yield packer.flush(last=True)
        # A vocabulary takes 40 MB in each worker.
        del encode
        encoder.cache_clear()
        release()

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
