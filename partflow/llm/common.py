"""Shared pieces of the training-data operators: word hashes over Arrow batches, bounded stores, salted joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.session import scratch_path

WHITE = b" \t\n\x0b\x0c\r"  # fixed value: the white space of the word rule [^\x20\x09-\x0D]+
BLOCK_BYTES = 1 << 20  # texts are hashed in blocks of about this size; a longer text is a block of its own


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, compressed on disk."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Join rows with a table that is unique by keys. A hot key's rows are dealt over salts tasks."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(salts)).cast("int"))
    right = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """The words of a run of texts: byte spans in one buffer, a 64-bit hash each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, lower: bool):
        """data: bytes of all texts; cuts: n + 1 offsets of the texts in data."""
        if lower:
            data = _LOWER[data]
        word = np.zeros(len(data) + 2, dtype=bool)
        word[1:-1] = ~_IS_WHITE[data]
        change = word[1:] != word[:-1]
        edges = np.flatnonzero(change)
        inner = cuts[1:-1]
        split = inner[(word[inner] & word[inner + 1])] if len(inner) else inner  # a word may touch the next text's first
        split = np.unique(split)
        if len(split):
            edges = np.sort(np.concatenate([edges, split, split]))
        self.data, self.starts, self.ends = data, edges[0::2], edges[1::2]
        forward, back = power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * forward[: len(data)], out=sums[1:])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.bounds = np.searchsorted(self.starts, cuts)

    def windows(self, k: int) -> np.ndarray:
        """A hash for each run of k words that begins at a word; runs that leave their text are for the caller to skip."""
        n = len(self.hashes) - k + 1
        if n < 1:
            return self.hashes[:0]
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xC6A4A7935BD1E995) + self.hashes[j : n + j]
        return mixed(out ^ np.uint64(k))


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pa.compute.fill_null(texts, b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))
