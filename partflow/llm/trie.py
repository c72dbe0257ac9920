"""Prefix trie of conversations: a count-min screen proves singleton prefixes, only possibly shared ones are grouped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.llm.bits import all_set, bit_table, cell_ids
from partflow.llm.common import dropped, mixed, salted_join, signed, stored
from partflow.session import materialized

ROWS = 4  # rows of the count-min sketch
LEAST_LOG, MOST_LOG = 20, 28  # the sketch has at least 2**20 and at most 2**28 cells, 32 MB of bits where they are broadcast
FAMILY, STEMS = 100, 6  # conversations of one hundred share a stem of at most five turns
KEY = ("depth", "p1", "p2")


# ---- running sums along conversations, without a conversation ever meeting in one task

def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def running(rows: DataFrame, key: str, order: Sequence[Column], sums: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """rows with inclusive running sums within each key, in the given order: sums maps new column -> summed long column.
    keep names the columns to carry on, all of them if not given.

    Rows are dealt by ranges of (key, order), so a long key spreads over many tasks. Each task sums its own range; one row a
    range tells the next ranges what they continue. Sums are modulo 2**64.
    """
    kept, lanes = list(keep or rows.columns), list(sums.values())
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = materialized(ranged.select(*dict.fromkeys([*kept, *lanes]), F.spark_partition_id().alias("__block")))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = current = None
        held = np.zeros(len(lanes), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _ints(batch, key)
            if first is None:
                first, block = int(keys[0]), batch.column("__block")[0].as_py()
            tail = int(np.searchsorted(keys, keys[-1]))  # keys are sorted
            if current != int(keys[-1]):
                held[:] = 0
            current = int(keys[-1])
            with np.errstate(over="ignore"):
                held += np.array([_ints(batch, c)[tail:].sum() for c in lanes], np.int64)
        if first is not None:
            yield pa.record_batch([pa.array([v]) for v in (block, first, current)] + [pa.array([held.tolist()], pa.list_(pa.int64()))], names=["block", "first", "last", "held"])

    carry, now, total = {}, None, np.zeros(len(lanes), np.int64)
    totals = placed.select("__block", key, *dict.fromkeys(lanes)).mapInArrow(last, "block long, first long, last long, held array<long>")
    for row in sorted(totals.collect(), key=lambda r: r.block):  # one row a range
        if now == row.first:
            carry[row.block] = total
        with np.errstate(over="ignore"):
            total = np.array(row.held, np.int64) + (total if now == row.first == row.last else 0)
        now = row.last

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, np.zeros(len(lanes), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _ints(batch, key)
            if current is None:
                current, held = int(keys[0]), carry.get(batch.column("__block")[0].as_py(), held)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            run = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
            out, ends = [], []
            for i, lane in enumerate(lanes):
                values = _ints(batch, lane)
                with np.errstate(over="ignore"):
                    total = np.cumsum(values)
                    before = total[starts] - values[starts]
                    if keys[0] == current:
                        before[0] -= held[i]
                    total = total - before[run]
                out.append(pa.array(total))
                ends.append(total[-1])
            current, held = int(keys[-1]), np.array(ends, np.int64)
            yield pa.record_batch([batch.column(c) for c in kept] + out, names=[*kept, *sums])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + [f"`{n}` long" for n in sums])
    return placed.mapInArrow(summed, kinds)


# ---- rebuilt conversations

def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, a, b, chars): a turn's place in its conversation, its 128-bit name and its code points.

    Turns go by turn (null first); rows of one turn by role, then text. A null role or text is empty. Rows without conv_id
    belong to no conversation and are left out.
    """
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    one = said.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(0), "role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(one, "conv_id", order, {"pos": "one"}, ["conv_id", "a", "b", "chars"]).select("conv_id", "pos", "a", "b", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: rows (conv_id, depth, a, b, chars, turns) and lengths (conv_id, turns), turnless ones included.

    Conversation c begins with the first h turns of conversation c - c % 100 (% as in SQL, the sign of c), h = crc32(c) % 6,
    and goes on with its own turns after its first h.
    """
    stem = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(STEMS)).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", stem).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = sizes.join(bases, "base", "left").withColumn("stem", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    known = stored(known.withColumn("turns", F.col("stem") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).select("conv_id", "base", "h", "stem", "turns"), "conversations")
    own = salted_join(turns, known.select("conv_id", "h", "stem", "turns"), ["conv_id"]).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("stem")).alias("depth"), "a", "b", "chars", "turns")
    first = turns.filter(F.col("pos") < STEMS).withColumnRenamed("conv_id", "base")
    shared = first.join(known.select("base", "conv_id", "stem", "turns"), "base").filter("pos <= stem")  # five turns a base, a hundred conversations
    return own.unionByName(shared.select("conv_id", F.col("pos").alias("depth"), "a", "b", "chars", "turns")), known.select("conv_id", "turns")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        depth = _ints(batch, "depth").view(np.uint64)
        with np.errstate(over="ignore"):
            place = mixed(depth * np.uint64(0x9E3779B97F4A7C15))
            t1 = mixed(_ints(batch, "a").view(np.uint64) ^ place)
            t2 = mixed(_ints(batch, "b").view(np.uint64) + mixed(place))
        yield pa.record_batch([batch.column(c) for c in ("conv_id", "depth", "chars", "turns")] + [signed(t1), signed(t2)], names=["conv_id", "depth", "chars", "turns", "t1", "t2"])


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: its 128-bit name (p1, p2), a sum over its turns of a hash of turn
    and place, and that of the prefix one turn shorter (q1, q2)."""
    terms = rows.mapInArrow(_terms, "conv_id long, depth long, chars long, turns long, t1 long, t2 long")
    summed = running(terms, "conv_id", [F.col("depth")], {"p1": "t1", "p2": "t2"})

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                q = [pa.array(_ints(batch, p) - _ints(batch, t)) for p, t in (("p1", "t1"), ("p2", "t2"))]
            keep = ["conv_id", "depth", "chars", "turns", "p1", "p2"]
            yield pa.record_batch([batch.column(c) for c in keep] + q, names=[*keep, "q1", "q2"])

    return summed.mapInArrow(before, "conv_id long, depth long, chars long, turns long, p1 long, p2 long, q1 long, q2 long")


# ---- the screen

def _cells(log_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _sketch_cells(_ints(batch, "p1"), _ints(batch, "p2"), log_size)
            yield pa.record_batch([pa.array(found.ravel())], names=["cell"])

    return run


def _sketch_cells(p1: np.ndarray, p2: np.ndarray, log_size: int) -> np.ndarray:
    """Each row of the sketch has its own quarter of the cells."""
    cells = cell_ids(mixed(p1.view(np.uint64)), mixed(p2.view(np.uint64)), ROWS, log_size - 2)
    return cells + (np.arange(ROWS, dtype=np.int64) << (log_size - 2))[:, None]


def screened(names: DataFrame, log_size: int | None = None) -> DataFrame:
    """names with `single` and `parent_single`: the count-min estimate of the prefix, or of the one before it, is one.

    An estimate is never too small, so a single prefix belongs to one conversation. Counts are summed by cell before they
    meet; of the sums only whether they pass one is broadcast, a bit a cell.
    """
    if log_size is None:
        log_size = min(MOST_LOG, max(LEAST_LOG, int(8 * names.count()).bit_length()))
    cells = names.select("p1", "p2").mapInArrow(_cells(log_size), "cell long")
    shared = bit_table(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), log_size)
    table = names.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [~all_set(table.value, _sketch_cells(_ints(batch, a), _ints(batch, b), log_size)) for a, b in (("p1", "p2"), ("q1", "q2"))]
            flags[1] &= _ints(batch, "depth") > 1  # the root is everybody's
            yield pa.record_batch(list(batch.columns) + [pa.array(f) for f in flags], names=[*batch.schema.names, "single", "parent_single"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.schema)
    return names.mapInArrow(run, f"{kinds}, single boolean, parent_single boolean")


# ---- nodes

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids as they stream by in order; no list of them is held."""
    now, running_digest, done = None, None, []
    for batch in batches:
        columns = [_ints(batch, c).tolist() for c in (*KEY, "conv_id")]
        for *key, conv in zip(*columns, strict=True):
            if key != now:
                if now is not None:
                    done.append((*now, running_digest.hexdigest()))
                now, running_digest = key, hashlib.sha256(str(conv).encode())
            else:
                running_digest.update(f",{conv}".encode())
        if len(done) > 10_000:
            yield _digest_batch(done)
            done = []
    if now is not None:
        done.append((*now, running_digest.hexdigest()))
    if done:
        yield _digest_batch(done)


def _digest_batch(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3])], names=[*KEY, "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of rows (depth, p1, p2, conv_id): SHA-256 of the ids, ascending and comma-joined.

    SHA-256 takes its input in order, so the ids of one node pass through one task; they pass as a sorted stream.
    """
    dealt = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, log_size: int | None = None) -> DataFrame:
    """One row a node of the trie of rebuilt conversations; see `rebuilt` for how they are built.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and n_ends,
    the members that end there. Rows of one turn order by role and text; repeated rows are turns of their own; a null role or
    text is empty; rows without conv_id and other columns are not read. Without conversations there is no root: no rows.
    Prefixes are named by 128 bits. Prefixes that the sketch proves single become nodes where they are read; all others meet
    by their names, counts being summed before they shuffle, and a node's share of its subtree is told by the smallest
    member of each node below, so no level waits for another.
    """
    spark = conversations.sparkSession
    turns = stored(numbered_turns(conversations), "turns")
    rows, lengths = rebuilt(turns)
    lengths = stored(lengths, "lengths")
    names = stored(prefixes(rows), "prefixes")
    flagged = stored(screened(names, log_size), "screened")
    dropped(turns), dropped(names)
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    shared = flagged.filter("NOT single")
    groups = stored(shared.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"), F.max("chars").alias("chars"), F.sum((F.col("depth") == F.col("turns")).cast("long")).alias("n_ends"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min(F.when(F.col("parent_single"), F.col("conv_id"))).alias("alone")), "groups")

    # what each conversation owns: nodes of which it is the smallest member, always the last of its path
    owned = groups.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    leaves = groups.filter("n_ends = n_convs").select(F.col("least").alias("conv_id"), zero.alias("own"), F.lit(1).cast("long").alias("leaf"))
    tails = flagged.filter("single AND depth = turns").select("conv_id", zero.alias("own"), F.lit(1).cast("long").alias("leaf"))
    sums = owned.select(F.col("least").alias("conv_id"), "own", zero.alias("leaf")).unionByName(leaves).unionByName(tails)
    told = stored(sums.groupBy("conv_id").agg(F.sum("own").alias("own"), F.max("leaf").alias("leaf")), "told")
    below = running(owned, "least", [F.col("depth").desc()], {"below": "own"})
    below = salted_join(below, told.select(F.col("conv_id").alias("least"), F.col("own").alias("least_own")), ["least"])

    # what members and children tell each node
    zeros = {c: zero for c in ("owns", "leaf", "children")}
    members = salted_join(shared.select(*KEY, "conv_id"), told, ["conv_id"], how="left").select(*KEY, F.coalesce("own", zero).alias("owns"), F.coalesce("leaf", zero).alias("leaf"), zero.alias("children"))
    child = groups.filter("alone IS NULL").select("depth", "q1", "q2").unionByName(flagged.filter("single AND NOT parent_single").select("depth", "q1", "q2"))
    up = child.filter("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).withColumns(zeros | {"children": F.lit(1).cast("long")})
    sums = members.unionByName(up).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in zeros])
    nodes = below.join(sums, list(KEY)).select("least", "depth", "q1", "q2", "alone", "n_convs", F.col("children").alias("n_children"), F.col("leaf").alias("n_leaves"),
                                               (F.col("below") + F.col("owns") - F.col("least_own")).alias("saved_tokens"), "n_ends", "p1", "p2")
    nodes = nodes.join(ends_digest(shared.filter("depth = turns")), list(KEY), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("p1", "p2")

    ended = F.col("depth") == F.col("turns")
    alone = flagged.filter("single").select(
        F.col("conv_id").alias("least"), "depth", "q1", "q2", F.when(F.col("parent_single"), F.col("conv_id")).alias("alone"), F.lit(1).cast("long").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), ended.cast("long").alias("n_ends"), F.when(ended, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"))

    root = _root(spark, lengths, groups, told, child)
    root_id = root.select("conv_id").scalar()
    nodes, ready = nodes.unionByName(alone), F.col("alone").isNotNull() | (F.col("depth") == 1)
    parents = groups.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("parent_conv_id"))
    near = nodes.filter(ready).withColumn("parent_conv_id", F.coalesce("alone", root_id))
    far = salted_join(nodes.filter(~ready), parents, ["depth", "q1", "q2"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends"]
    return root.select(*columns).unionByName(near.unionByName(far, allowMissingColumns=True).withColumnRenamed("least", "conv_id").select(*columns))


def _root(spark: SparkSession, lengths: DataFrame, groups: DataFrame, told: DataFrame, child: DataFrame) -> DataFrame:
    """The textless root: everybody is a member; its subtree is the whole trie."""
    count = F.count(F.lit(1))
    all_of = lengths.agg(count.alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum((F.col("turns") == 0).cast("long")), F.lit(0).cast("long")).alias("n_ends"))
    saved = groups.agg(F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), F.lit(0).cast("long")).alias("v")).select("v").scalar()
    leaves = told.agg(F.greatest(F.coalesce(F.sum("leaf"), F.lit(0).cast("long")), F.lit(1).cast("long")).alias("v")).select("v").scalar()
    children = child.filter("depth = 1").agg(count.alias("v")).select("v").scalar()
    turnless = lengths.filter("turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id")
    digest = F.coalesce(ends_digest(turnless).select("ends_sha256").scalar(), F.sha2(F.lit("").cast("binary"), 256))
    return all_of.filter("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", children.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"), digest.alias("ends_sha256"), "n_ends")
