"""Line dedup: levelled sorted runs of line hashes, compacted as they pile up; each new batch is merge-anti-joined with them."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.llm.common import WHITE, dropped, salted_join, stored
from partflow.session import scratch_path

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 6, 3  # batches of documents, and runs of a level that are merged into one of the next


def _key(line: bytes) -> bytes | None:
    """The hash of a line's key, or nothing when the key is too short to judge."""
    key = line.strip(WHITE).lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            mine = {_key(line) for line in (text.as_py() or b"").split(b"\n")}
            mine.discard(None)
            keys.extend(mine)
            rows.extend([i] * len(mine))
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([pa.array(keys, pa.binary()), batch.column("doc_id").take(at), batch.column("row").take(at)], names=["line", "doc_id", "row"])


def line_entries(docs: DataFrame) -> DataFrame:
    """(line, doc_id, row): the hash of each distinct key of at least 20 code points that a text holds; row is a hash of the text."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_entries, "line binary, doc_id long, row long")


class LineRuns:
    """Levels of sorted runs (line, n_docs, max_doc), no line twice in a run.

    Each batch is merge-joined with the runs. Lines that no run holds enter with their largest doc_id; of lines that one
    holds only the count is added. Batches come in falling doc_id, so the first one that has a line has its largest id.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    @staticmethod
    def _sorted(run: DataFrame) -> DataFrame:
        return stored(run.select("line", "n_docs", "max_doc").sortWithinPartitions("line"), "line-run")

    def add(self, entries: DataFrame) -> None:
        """A batch of entries becomes a run of level 0; a full level is merged into one run of the next."""
        batch = self._sorted(entries.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
        new = self.unseen(batch).select("line", "max_doc")
        self.levels[0].append(self._sorted(batch.select("line", "n_docs").join(new, "line", "left")))
        dropped(batch)
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                old, self.levels[at] = self.levels[at], []
                self.levels[at + 1].append(self._sorted(self._merged(old)))
                for run in old:
                    dropped(run)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        if len(runs) == 1:
            return runs[0]
        return functools.reduce(DataFrame.unionByName, runs).groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def merged(self) -> DataFrame:
        """(line, n_docs, max_doc) over all runs; one run is read as it is."""
        return self._merged([run for level in self.levels for run in level])

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose line no run holds: a merge-anti-join with each run."""
        for level in self.levels:
            for run in level:
                batch = batch.join(run.select("line").hint("merge"), "line", "left_anti")
        return batch


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__lost").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [line for line in lines if _key(line) not in drop]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines) if drop else text)
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "__lost")}
        columns |= {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def _batched(docs: DataFrame, batches: int) -> DataFrame:
    """The entries of all texts, hashed once and stored by batch: 0 has the largest ids, the last one the null ids."""
    spark = docs.sparkSession
    shares = [F.lit(i / batches) for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*shares)).alias("cuts")).first()["cuts"] if shares else []
    at = F.lit(0)
    for cut in cuts or []:  # as many as there are batches
        at = at + F.when(F.col("doc_id") < cut, 1).otherwise(0)
    path = scratch_path(spark, "line-entries")
    entries = line_entries(docs).withColumn("batch", F.when(F.col("doc_id").isNull(), batches).otherwise(at))
    entries.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return spark.read.schema(entries.schema).parquet(path)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, keep: Sequence[str] = ("doc_id", "text"), fanout: int = FANOUT) -> DataFrame:
    """Texts without the lines that at least min_docs documents hold, except in the largest doc_id holding each.

    Returns the columns to keep, n_lines (before dropping), n_dropped. A null or empty text is one empty line; a null text stays
    null. Rows that repeat a doc_id count as one document each while lines are counted, and both lose the same lines. A null
    doc_id loses every common line unless all holders are null. Lines of a key under 20 code points always stay. An empty
    table gives no rows; further columns do no harm. Texts are hashed once; what a text loses is gathered by doc_id and text.
    """
    entries, runs = _batched(docs.select("doc_id", "text"), batches), LineRuns(fanout)
    for b in range(batches + 1):
        runs.add(entries.filter(F.col("batch") == b))
    common = runs.merged().filter(F.col("n_docs") >= min_docs).select("line", "max_doc")
    hits = salted_join(entries.select("line", "doc_id", "row"), common, ["line"]).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    lost = hits.groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__text")).agg(F.collect_set("line").alias("__lost"))
    rows = docs.select(*keep, F.xxhash64("text").alias("__row"))
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__text")), "left").select(*keep, "__lost")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema if f.name != "text")
    return rows.mapInArrow(_filter, f"{kinds}, text string, n_lines long, n_dropped long").select(*keep, "n_lines", "n_dropped")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
