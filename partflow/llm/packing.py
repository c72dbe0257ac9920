"""Bounded-space best-fit packing: a fixed number of open bins, found through a bitset keyed by free space."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.llm.bpe import parse_ranks
from partflow.llm.common import stored

LENGTH, OPEN_BINS, END_ID = 1024, 512, 2
SECOND_TASK_TOKENS = 1 << 25  # tokens left over by the first pass that one task of the second packs at least: its last open bins do not show
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """At most `limit` open bins of `length` places. Bit f of the bitset says that some open bin has f places free."""

    def __init__(self, length: int, limit: int, first_id: int):
        self.length, self.limit, self.next_id = length, limit, first_id
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _put(self, free: int, held: list) -> None:
        self.by_free.setdefault(free, []).append(held)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        held = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return held

    def add(self, size: int, item: tuple) -> list[list]:
        """Place an item in the open bin it fills best, else in a new one. Returns the bins that closed: full ones, and the
        fullest when there are too many."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            held = self._take(free)
        else:
            free, held = self.length, []
        held.append((size, item))
        if free == size:
            return [held]
        self._put(free - size, held)
        return [self._take((self.bits & -self.bits).bit_length() - 1)] if self.count > self.limit else []

    def leave(self) -> list[list]:
        """What the bins still open hold, bin by bin."""
        rest = [held for group in self.by_free.values() for held in group]
        self.by_free, self.bits, self.count = {}, 0, 0
        return rest

    def close(self) -> list[list]:
        """The open bins, the emptiest of them poured together where they fit: best fit once more, over whole bins."""
        for held in sorted(self.leave(), key=lambda held: -sum(size for size, _ in held)):
            used = sum(size for size, _ in held)
            fitting = self.bits >> used
            free = used + (fitting & -fitting).bit_length() - 1 if fitting else self.length
            self._put(free - used, (self._take(free) if fitting else []) + held)
        return self.leave()

    def rows(self, held: list) -> list[tuple]:
        offset, out = 0, []
        for size, item in held:
            out.append((*item, self.next_id, offset))
            offset += size
        self.next_id += 1
        return out


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """The entries that a tokenizer file adds to its vocabulary: they are cut out of a text before anything else."""
    with open(tokenizer_file, encoding="utf-8") as f:
        entries = json.load(f)["added_tokens"]
    if any(e["lstrip"] or e["rstrip"] or e["single_word"] or e["normalized"] for e in entries):
        raise ValueError("only added tokens that match as they stand are known")
    return {e["content"]: e["id"] for e in entries}


_encoders: dict[tuple, tiktoken.Encoding] = {}


def _encoder(content: bytes, pattern: str, added: Mapping[str, int]) -> tiktoken.Encoding:
    """One encoder a Python worker, kept between tasks."""
    key = (hash(content), pattern, tuple(added.items()))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens=dict(added))
    return _encoders[key]


def pieces_of(doc_id: int | None, ids: bytes, length: int) -> Iterator[tuple[int, tuple]]:
    """A document's pieces: whole if it fits, else full pieces after a first one that takes what is over."""
    n = len(ids) // 4
    first = n if n <= length else n % length or length
    at, piece, to = 0, 0, first
    while at < n:
        yield to - at, (doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]))
        at, piece, to = to, piece + 1, min(to + length, n)


_NAMES = [f.split()[0] for f in PACKED.split(", ")]


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, _NAMES, strict=True)], names=_NAMES)


def _repacked(batches: Iterator[pa.RecordBatch], length: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """The second pass: pieces that the first left in open bins, packed by best fit in the order they come."""
    bins = OpenBins(length, open_bins, 1 << 62 | TaskContext.get().partitionId() << 36)
    for batch in batches:
        items = zip(*[batch.column(c).to_pylist() for c in _NAMES[:5]], strict=True)
        if rows := [r for item in items for closed in bins.add(item[3], item) for r in bins.rows(closed)]:
            yield _batch_of(rows)
    if rows := [r for held in bins.close() for r in bins.rows(held)]:
        yield _batch_of(rows)


def pack(docs: DataFrame, rank_file: str, pattern: str, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID, added: Mapping[str, int] | None = None) -> DataFrame:
    """Pieces of documents with their sequence and place in it; see PACKED.

    The ids are those of byte-level BPE by the ranks, each match of the pattern apart; strings of `added` are one token
    each, as a tokenizer with such entries takes them. Each task packs the documents it reads as they come, with at most
    open_bins open bins, so no text is shuffled; of bins of one free space the latest is filled. What a task's open bins hold
    in the end is dealt anew, pieces without their texts, and packed by the same rule in as few tasks as its size asks for, so
    the number of sequences hardly depends on how the table is cut into files. A null or empty text is the end id alone. Rows
    that repeat a doc_id are documents of their own; null ids and other columns do no harm; an empty table gives no rows.
    sequence_id is pass, task and a count, the same when a task is run again.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())
    added = dict(added or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(content.value, pattern, added), np.asarray([end_id], "<u4").tobytes()
        bins = OpenBins(length, open_bins, TaskContext.get().partitionId() << 36)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""
                for size, item in pieces_of(doc_id, ids + end, length):
                    for closed in bins.add(size, item):
                        rows += bins.rows(closed)
            if rows:
                yield _batch_of(rows)
        if rows := [(*item, None, None) for held in bins.leave() for _, item in held]:
            yield _batch_of(rows)

    packed = stored(docs.select("doc_id", "text").mapInArrow(run, PACKED), "packed")
    left = packed.filter("sequence_id IS NULL")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    again = left.repartition(1 + tokens // SECOND_TASK_TOKENS, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return packed.filter("sequence_id IS NOT NULL").unionByName(again.mapInArrow(lambda batches: _repacked(batches, length, open_bins), PACKED))
