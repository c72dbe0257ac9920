"""Substring dedup: words that lie in any run of 35 words found twice are removed, by suffix groups of shared prefixes.

The suffixes of all texts fall into groups by a prefix of several words, and only groups that hold two or more go deeper: a
suffix tree grown level by level, of which no task holds more than its groups. Three prefix lengths are used. (1) A prefix of
12 words, taken only at each window's smallest 12-word hash: equal windows choose equal places, so a tenth of the suffixes
tells which windows may repeat. (2) The whole span of the windows that chose one place: where two spans agree, all their
windows repeat and need no deeper look. (3) The single windows of 35 words of spans that share (1) but not (2): the edges
of repeats. Nodes at that depth with two or more suffixes are the repeats; their runs of words are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.llm.common import Words, power_tables, blocks, mixed, signed, stored

WINDOW, PREFIX = 35, 12
PLACES = "array<struct<k:bigint,lo:int,hi:int>>"
_PLACE = pa.struct([("k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


class Spans:
    """Hashes of any run of words of a block."""

    def __init__(self, words: Words):
        forward, self.back = power_tables(len(words.hashes) + 1)
        self.sums = np.zeros(len(words.hashes) + 1, np.uint64)
        np.cumsum(words.hashes * forward[: len(words.hashes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def chosen(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, place) of each run of windows that choose the same place, as word numbers."""
    starts = [np.arange(a, b - window + 1) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True) if b - a >= window]
    if not starts:
        return (np.zeros(0, np.int64),) * 4
    starts = np.concatenate(starts)
    view = np.lib.stride_tricks.sliding_window_view(words.windows(prefix), window - prefix + 1)
    place = np.concatenate([starts[i : i + 65536] + view[starts[i : i + 65536]].argmin(axis=1) for i in range(0, len(starts), 65536)])
    row = np.searchsorted(words.bounds, starts, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    return row[new], starts[new], starts[last], place[new]


def merged(keys: list[np.ndarray], k: np.ndarray, lo: np.ndarray, hi: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, k, lo, hi, more), one for each distinct key: more lists the places of a key that came several times."""
    if not len(k):
        return
    order = np.lexsort(keys[::-1])
    keys, k, lo, hi = [x[order] for x in keys], k[order], lo[order], hi[order]
    change = np.zeros(len(k), bool)
    change[0] = True
    for x in keys:
        change[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(k)))
    names = [*names, "k", "lo", "hi", "more"]
    one, more = first[count == 1], first[count > 1]
    yield pa.record_batch([*[signed(x[one]) for x in keys], pa.array(k[one]), pa.array(lo[one], pa.int32()), pa.array(hi[one], pa.int32()), pa.nulls(len(one), pa.list_(_PLACE))], names=names)
    if len(more):
        held = np.repeat(count > 1, count)
        offsets = np.concatenate([[0], np.cumsum(count[count > 1])]).astype(np.int32)
        places = pa.StructArray.from_arrays([pa.array(k[held]), pa.array(lo[held], pa.int32()), pa.array(hi[held], pa.int32())], fields=list(_PLACE))
        empty = [pa.nulls(len(more), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
        yield pa.record_batch([*[signed(x[more]) for x in keys], *empty, pa.ListArray.from_arrays(pa.array(offsets), places)], names=names)


def _prefixes(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("k").to_numpy(zero_copy_only=False), []
            for at, _, words in blocks(batch.column("text"), lower=False):
                row, lo, hi, place = chosen(words, window, prefix)
                if len(row):
                    spans = Spans(words)
                    span = mixed(spans.of(lo, hi + window) ^ ((place - lo).astype(np.uint64) << np.uint64(32)))
                    begin = words.bounds[row]
                    parts.append((spans.of(place, place + prefix), span, ids[at + row], lo - begin, hi - begin))
            if parts:
                prefix_hash, span, k, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from merged([prefix_hash, span], k, lo, hi, ["prefix", "span"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked, parts = batch.column("k").to_numpy(zero_copy_only=False), batch.column("asked").to_pylist(), []
            for at, to, words in blocks(batch.column("text"), lower=False):
                starts, rows = [], []
                for i in range(at, to):
                    begin = words.bounds[i - at]
                    for span in asked[i]:
                        starts.append(np.arange(begin + span["lo"], begin + span["hi"] + 1))
                        rows.append(np.full(len(starts[-1]), i))
                if starts:
                    starts, rows = np.concatenate(starts), np.concatenate(rows)
                    own = starts - words.bounds[rows - at]
                    parts.append((Spans(words).of(starts, starts + window), ids[rows], own, own))
            if parts:
                value, k, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from merged([value], k, lo, hi, ["value"])

    return run


def _cut(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if spans:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, [s["lo"] for s in spans], 1)
                    np.add.at(steps, [s["hi"] + window for s in spans], -1)
                    keep = np.cumsum(steps[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                texts.append(None if text is None else b" ".join(words))
            columns = {c: batch.column(c) for c in names if c != "text"}
            columns |= {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _places() -> Column:
    return F.posexplode(F.coalesce("more", F.array(F.struct("k", "lo", "hi"))))


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(k, lo, hi): windows lo to hi, counted in words, of the text with key k occur somewhere else too. docs: k, text."""
    weight = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more")))
    rows = docs.mapInArrow(_prefixes(window, prefix), f"prefix long, span long, k long, lo int, hi int, more {PLACES}")
    same = Window.partitionBy("prefix", "span")
    rows = rows.withColumn("in_prefix", weight.over(Window.partitionBy("prefix"))).filter("in_prefix > 1")
    rows = rows.withColumn("in_span", weight.over(same)).withColumn("rank", F.row_number().over(same.orderBy(F.coalesce("k", F.col("more")[0]["k"]), F.coalesce("lo", F.col("more")[0]["lo"]))))
    asked = (F.col("in_prefix") > F.col("in_span")) & (F.col("rank") == 1) & (F.col("pos") == 0)  # one of each span is enough
    spans = rows.select("in_prefix", "in_span", "rank", _places()).select((F.col("in_span") > 1).alias("sure"), asked.alias("asked"), "col.*")
    spans = stored(spans.filter("sure OR asked"), "spans")
    wanted = spans.filter("asked").groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
    singles = docs.join(wanted, "k").mapInArrow(_windows(window), f"value long, k long, lo int, hi int, more {PLACES}")
    singles = singles.withColumn("n", weight.over(Window.partitionBy("value"))).filter("n > 1").select(_places()).select("col.*")
    return spans.filter("sure").select("k", "lo", "hi").unionByName(singles)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """Texts without the words that a repeated window covers, in every place where it stands, the same text included.

    Returns the columns to keep, n_words (before), n_removed; the words left are joined by one space. A null text stays null
    with no words, an empty one stays empty. Rows that repeat a document are places of their own, so both lose all their
    windows. Texts of fewer than 35 words lose nothing.
    """
    keyed = docs.select(*keep).withColumn("k", F.xxhash64("doc_id", "text"))
    found = repeated_spans(keyed.filter("text IS NOT NULL").select("k", "text"), window, min(PREFIX, window))
    spans = found.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema if f.name != "text")
    out = keyed.join(spans, "k", "left").select(*keep, "spans").mapInArrow(_cut(window, list(keep)), f"{kinds}, text string, n_words long, n_removed long")
    return out.select(*keep, "n_words", "n_removed")
