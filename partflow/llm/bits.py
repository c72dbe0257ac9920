"""Bit tables of a fixed size that tasks build together and every task then reads: Bloom filters, screens of a sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK_BITS = 16


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for places in batch.column("places"):
            bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
            bits[places.values.to_numpy(zero_copy_only=False)] = 1
            rows.append(np.packbits(bits).tobytes())
        yield pa.record_batch([batch.column("chunk"), pa.array(rows, pa.binary())], names=["chunk", "bits"])


def bit_table(cells: DataFrame, log_size: int) -> np.ndarray:
    """The table of 2**log_size bits with the bits of `cells` (cell long, below that size) set, as bytes.

    What reaches the driver is at most the table, 2**log_size / 8 bytes, whatever the number of rows.
    """
    table = np.zeros(1 << (log_size - 3), np.uint8)
    chunks = (cells.select("cell").distinct()
              .groupBy(F.shiftright("cell", _CHUNK_BITS).cast("int").alias("chunk"))
              .agg(F.collect_set(F.col("cell").bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)).cast("int")).alias("places"))
              .mapInArrow(_packed, "chunk int, bits binary"))
    width = 1 << (_CHUNK_BITS - 3)
    for row in chunks.collect():
        table[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return table


def cell_ids(one: np.ndarray, two: np.ndarray, probes: int, log_size: int) -> np.ndarray:
    """(probes, n) cells of names given as two 64-bit hashes."""
    with np.errstate(over="ignore"):
        steps = [(one + np.uint64(i) * (two | np.uint64(1))) for i in range(probes)]
    return np.stack([s >> np.uint64(64 - log_size) for s in steps]).astype(np.int64)


def all_set(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether all cells of each name are set."""
    hit = (table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
    return hit.all(axis=0)
