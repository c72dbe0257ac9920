"""Lempel-Ziv phrase fingerprints: the hashed set of the phrases a text parses into, kept as minimum hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 128  # minimum hashes a fingerprint; each is kept as 16 bits
LIKENESS_ERROR = 0.045  # largest standard error of a likeness by 128 slots
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-鿿ꀀ-꓏가-퟿豈-﫿\U00020000-\U0003ffff]")
_SYMBOL = re.compile(_UNSPACED.pattern + "|[^\\x20\\x09-\\x0D" + _UNSPACED.pattern[1:])
_A = np.random.default_rng(7).integers(1, 1 << 62, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(1, 1 << 62, SLOTS, dtype=np.uint64)


def symbols(text: str) -> list[bytes]:
    """What the parse reads: words, and single characters of scripts that are written without spaces."""
    if text.isascii() or not _UNSPACED.search(text):
        return text.encode().split()
    return [s.encode() for s in _SYMBOL.findall(text)]


def phrases(text: str) -> set[bytes]:
    """LZ78: each phrase is the longest phrase met before plus one symbol."""
    seen: set[bytes] = set()
    phrase = b""
    for symbol in symbols(text):
        phrase = phrase + b" " + symbol if phrase else symbol
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return seen


def signature(text: str) -> np.ndarray:
    """Minimum hashes of the phrase set as 16-bit numbers; all zero for a text without symbols."""
    found = phrases(text)
    if not found:
        return np.zeros(SLOTS, np.uint16)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    return slots_of(hashes)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """One permutation: a hash's top bits name its slot, which keeps its minimum; an empty slot borrows from another by a
    rule that depends on the slot only."""
    slot = (hashes >> np.uint64(57)).astype(np.int64)
    value = hashes & np.uint64((1 << 57) - 1)
    order = np.argsort(hashes)  # by slot and then by value
    slot, value = slot[order], value[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out, full = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
    out[slot[first]], full[slot[first]] = value[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        kept = out.copy()
        step = 0
        while len(empty):
            step += 1
            source = ((_A[empty] * np.uint64(step) + _B[empty]) >> np.uint64(55)).astype(np.int64) % SLOTS
            hit = full[source]
            out[empty[hit]] = kept[source[hit]] + np.uint64(step)
            empty = empty[~hit]
    x = out * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(48)) ^ (x >> np.uint64(20))).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard likeness of the phrase sets: shared slots, less what 16 bits agree on by chance."""
    return float(np.count_nonzero(a == b)) / SLOTS


def hexed(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: 128 minimum hashes of 16 bits in hex. A null text counts as empty; equal texts have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([hexed(signature(t or "")) for t in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bucket_of(value: Column, cuts: list[int], first: int = 0) -> Column:
    """The range a value falls in, numbered from the largest values down; null in the last. A balanced tree of conditions."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    above, below = _bucket_of(value, cuts[middle + 1 :], first), _bucket_of(value, cuts[:middle], first + len(cuts) - middle)
    return F.when(value > F.lit(cuts[middle]), above).otherwise(below)


CHAINED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_chain(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next one's, and both likenesses; see CHAINED.

    The next document follows by descending doc_id, the first follows the last; null ids come last, equal ids go by text.
    Texts are shuffled once: ids are cut into ranges, each range is sorted, and the first document of a range is copied to
    the end of the range before it. A single document follows itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * tasks  # several a task, so that none gets much more than its share
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _bucket_of(F.col("doc_id"), cuts).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # a row a range
    if not heads:
        return spark.createDataFrame([], CHAINED)
    before = spark.createDataFrame([(r["head"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)], "head long, bucket int")
    found = rows.drop("bucket").join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("head")))
    tails = found.groupBy("doc_id", "bucket").agg(F.min("text").alias("text")).withColumn("tail", F.lit(1))
    dealt = rows.withColumn("tail", F.lit(0)).unionByName(tails).repartition(tasks, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHAINED.split(", ")]
        last = None  # bucket, doc_id, text, signature of the row before
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, at, tail in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")], strict=True):
                mine = signature(text)
                if last is not None and last[0] == at:
                    changed = edited(last[2], text)
                    other = signature(changed)
                    for column, value in zip(out, (last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), hexed(last[3]), hexed(other), likeness(last[3], other), likeness(last[3], mine)), strict=True):
                        column.append(value)
                last = None if tail else (at, doc_id, text, mine)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, CHAINED)
