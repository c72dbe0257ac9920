"""N-gram Jaccard join: exact components of documents whose word-shingle sets are alike, by regions of pivots.

Jaccard distance is a metric. A first level of pivots is single shingles: a document can only have a partner in the regions
of its rarest shingles, as many as a partner may lack. Regions that share documents are joined to one, whose pivots are
documents: each settles what lies within the radius, and the triangle inequality tells which settled documents may still have
a partner outside, so that they are copied to the rest, which is joined again. Regions too large for one task are first parted
by counting all of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partflow.llm.common import Words, blocks, mixed, salted_join, signed, stored
from partflow.llm.graph import components

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # words a shingle; the least likeness as a fraction
RADIUS = 1 - NUMERATOR / DENOMINATOR
SLACK = 1e-9  # of distances in windows, never in links
COUNTED = 0.26  # shingles whose hash lies in this share of all hashes are counted over the corpus; the rest come last
COUNTED_BELOW = int(COUNTED * 2**64)
REGION_SHINGLES = 3_000_000  # a region of more is cut, by its own counts and by pivots, before one task joins it
BAND = 1.26  # of set sizes: partners lie in one band or in two that are next to each other
NEAR = 2 * RADIUS  # a document farther from all pivots is in no pivot's cell for its own sake
PIVOTS, ROUNDS = 8, 4  # document pivots a region and round; rounds before what is left is joined block by block


def shingle_sets(words: Words, k: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: k words each, or all words of a text that has fewer."""
    whole = words.windows(k)
    for at, to in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if to - at >= k:
            yield np.unique(whole[at : to - k + 1])
        elif to > at:
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in words.hashes[at:to]:
                    value = value * np.uint64(0xC6A4A7935BD1E995) + h
            yield mixed(np.asarray([value ^ np.uint64(to - at)]))
        else:
            yield np.zeros(0, np.uint64)


def digest_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer: the same for the same set."""
    total = np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mixed(np.asarray([total + np.uint64(len(shingles))])).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, words in blocks(batch.column("text"), lower=True):
        for i, shingles in enumerate(shingle_sets(words)):
            yield at + i, shingles


def reach(n: int) -> int:
    """How many shingles of a set of n must be looked at so that a partner shares at least one of them."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, n, counted = [], [], []
        for _, shingles in _sets(batch):
            node.append(digest_of(shingles) if len(shingles) else None)
            n.append(len(shingles))
            counted.append(int(np.searchsorted(shingles, np.uint64(COUNTED_BELOW))))
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(counted, pa.int64())], names=["doc_id", "key", "node", "n_shingles", "n_counted"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a batch that is counted or within reach, with the sets that hold it. Rows of one batch
    are merged here, so a shingle of a third of all documents sends one row a batch."""
    for batch in batches:
        names, parts, known = [], [], set()
        for _, shingles in _sets(batch):
            if len(shingles) and (name := digest_of(shingles)) not in known:
                known.add(name)
                part = shingles[: max(reach(len(shingles)), int(np.searchsorted(shingles, np.uint64(COUNTED_BELOW))))]
                names.append(name)
                parts.append(part)
        if not parts:
            continue
        sizes = np.asarray([len(p) for p in parts])
        shingle, node = np.concatenate(parts), np.repeat(np.asarray(names, np.int64), sizes)
        order = np.argsort(shingle, kind="stable")
        shingle, node = shingle[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        count = np.diff(np.append(first, len(shingle)))
        one, more = first[count == 1], first[count > 1]
        yield pa.record_batch([signed(shingle[one]), pa.array(node[one]), pa.nulls(len(one), pa.list_(pa.int64()))], names=["shingle", "node", "nodes"])
        if len(more):
            held = np.repeat(count > 1, count)
            offsets = np.concatenate([[0], np.cumsum(count[count > 1])]).astype(np.int32)
            yield pa.record_batch([signed(shingle[more]), pa.nulls(len(more), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[held]))], names=["shingle", "node", "nodes"])


def candidate_edges(docs: DataFrame, described: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that share a shingle within reach of both, each set tied to the smallest of the region.

    One order for all: counted shingles from rare to common, then the rest by hash. A set's reach begins with the shingles
    no other set holds; only what is left of it can meet a partner.
    """
    rows = docs.select("text").mapInArrow(_regions, "shingle long, node long, nodes array<long>")
    rows = rows.withColumn("weight", F.when(F.col("nodes").isNull(), 1).otherwise(F.size("nodes")))
    held = rows.withColumn("holders", F.sum("weight").over(Window.partitionBy("shingle"))).filter("holders > 1")
    held = held.select("shingle", "holders", F.explode(F.coalesce("nodes", F.array("node"))).alias("node"))
    counted = (F.col("shingle") >= 0) & (F.col("shingle") < COUNTED_BELOW)
    last = F.lit(1 << 62)
    mine = held.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.when(counted, F.col("holders")).otherwise(last).alias("holders"), "shingle"))).alias("held"))
    mine = mine.withColumn("shared", F.size(F.filter("held", lambda h: h["holders"] < last)))
    sets = described.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("n_counted").alias("n_counted"))
    n = F.col("n")
    within = n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1 - F.col("n_counted") + F.col("shared")
    open_sets = mine.join(sets, "node").withColumn("within", within.cast("int")).filter("within > 0")
    return _tied(open_sets.select("node", F.explode(F.slice("held", F.lit(1), F.col("within"))["shingle"]).alias("shingle")))


def _tied(reached: DataFrame) -> DataFrame:
    """Edges (a, b) that tie each node to the smallest one of each shingle it reaches; reached: node, shingle."""
    regions = stored(reached, "regions")
    least = regions.groupBy("shingle").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return salted_join(regions, least, ["shingle"]).select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def join_region(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (node, representative) that give the components of the links inside one region, exactly.

    A pivot from the open documents takes in all within the radius. Of these only those stay, as a border, whose distance to
    the pivot is within a radius of that of some document left outside: no other can have a partner there. Those that may
    have a partner among the border of another component stay open and become pivots themselves.
    """
    size = np.asarray([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]  # of each shingle in turn
    first = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def around(pivot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, shared shingles, distance) of what lies within two radii of a pivot; nothing farther matters."""
        mine = ids[offsets[pivot] : offsets[pivot + 1]]
        begin, count = first[mine], first[mine + 1] - first[mine]
        steps = np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        inner = np.bincount(holders[steps], minlength=len(nodes))
        met = np.flatnonzero(inner)
        inner = inner[met]
        distance = 1 - inner / (size[pivot] + size[met] - inner)
        near = (distance <= 2 * RADIUS + SLACK) & (met != pivot)
        return met[near], inner[near], distance[near]

    gone, opened, border = 0, 1, 2
    state = np.full(len(nodes), opened)
    for pivot in np.argsort(-size, kind="stable").tolist():
        if state[pivot] != opened:
            continue
        state[pivot] = gone
        met, inner, distance = around(pivot)
        there = state[met] != gone
        met, inner, distance = met[there], inner[there], distance[there]
        linked = DENOMINATOR * inner >= NUMERATOR * (size[pivot] + size[met] - inner)
        for i in met[linked].tolist():
            parent[root(i)] = root(pivot)
        was_open = state[met] == opened
        home = root(pivot)
        foreign = np.asarray([not o and root(i) != home for i, o in zip(met.tolist(), was_open.tolist(), strict=True)], bool)
        reach_of = lambda some: distance[some].min(initial=2.0) - RADIUS - SLACK
        taken = was_open & linked
        again = taken & (distance >= reach_of(foreign))  # a border document of another component may be a partner
        kept = taken & ~again & (distance >= reach_of(was_open & ~linked))
        state[met[taken & ~again]] = gone
        state[met[kept]] = border
    return [(nodes[i], nodes[root(i)]) for i in range(len(nodes)) if root(i) != i]


def _join_table(table: pa.Table) -> pa.Table:
    rows = dict(zip(table.column("node").to_pylist(), table.column("shingles").to_pylist(), strict=True))
    nodes = sorted(rows)
    links = join_region(nodes, [np.frombuffer(rows[n], np.uint64) for n in nodes])
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _pivot_groups(packs: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """The pivots' sets and for each the first pivot that links tie it to."""
    sets = [np.frombuffer(p, np.uint64) for p in packs]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            inner = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if group[i] != group[j] and DENOMINATOR * inner >= NUMERATOR * (len(sets[i]) + len(sets[j]) - inner):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sets, group


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of each document to its region's pivots; the cells whose windows it falls in. Linked pivots share a cell. What
    is near to no pivot stays together in a cell of its own, as almost all of a region may be far from all pivots."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        known: dict[str, tuple[list[np.ndarray], list[int]]] = {}
        for region, node, packed, names, packs in zip(*[batch.column(c).to_pylist() for c in ("region", "node", "shingles", "pivots", "pivot_shingles")], strict=True):
            mine = np.frombuffer(packed, np.uint64)
            if region not in known:
                known[region] = _pivot_groups(packs)
            nearest: dict[int, float] = {}
            linked: set[int] = set()
            for theirs, g in zip(*known[region], strict=True):
                inner = len(np.intersect1d(mine, theirs, assume_unique=True))
                union = len(mine) + len(theirs) - inner
                nearest[g] = min(nearest.get(g, 2.0), 1 - inner / union)
                if DENOMINATOR * inner >= NUMERATOR * union:
                    linked.add(g)
            least = min(nearest.values())
            window = min(least, NEAR - RADIUS) + 2 * RADIUS + SLACK
            cells = [(names[g], names[g] if g in linked else None, d, g in linked) for g, d in nearest.items() if g in linked or d <= window]
            if least > NEAR:
                cells.append(("*", None, least, False))
            for name, link, d, settled in cells:
                for column, value in zip(out, (f"{region}/{name}", node, packed, link, d, settled), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.bool_())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["region", "node", "shingles", "link", "distance", "settled"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set."""
    for batch in batches:
        sets = [np.frombuffer(p, np.uint64) for p in batch.column("shingles").to_pylist()]
        size = np.asarray([len(s) for s in sets], np.int64)
        if not size.sum():
            continue
        rows = pa.array(np.repeat(np.arange(len(sets)), size))
        yield pa.record_batch([batch.column("region").take(rows), batch.column("node").take(rows), pa.array(np.repeat(size, size)), signed(np.concatenate(sets))], names=["region", "node", "n", "shingle"])


def refined(rows: DataFrame, banded: bool = False) -> DataFrame:
    """Regions cut by what their own members hold; rows and result: region, node, shingles.

    Every shingle is counted, not a share of them, and only over the region, so that a set's reach has more that nobody else
    holds and rarer shingles else; sets without a possible partner drop out. Banded, sets meet only with those of a size
    that a partner may have: each is in the cell of its band and in that of the band below.
    """
    if banded:
        band = F.floor(F.log(F.length("shingles") / 8.0) / F.log(F.lit(BAND))).cast("int")
        rows = rows.withColumn("region", F.explode(F.transform(F.array(band - 1, band), lambda b: F.concat_ws("~", "region", b))))
    postings = rows.select("region", "node", "shingles").mapInArrow(_postings, "region string, node long, n long, shingle long")
    held = postings.withColumn("holders", F.count("*").over(Window.partitionBy("region", "shingle"))).filter("holders > 1")
    mine = held.groupBy("region", "node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("held"))
    within = (F.size("held") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1).cast("int")
    open_sets = mine.withColumn("within", within).filter("within > 0")
    reached = open_sets.select("region", F.xxhash64("region", "node").alias("node"), F.explode(F.slice("held", F.lit(1), F.col("within"))["shingle"]).alias("shingle"))
    found = components(_tied(reached.select("node", F.xxhash64("region", "shingle").alias("shingle"))))
    named = rows.withColumn("__name", F.xxhash64("region", "node")).join(found.withColumnRenamed("node", "__name"), "__name")
    return named.select(F.concat_ws("#", "region", "component").alias("region"), "node", "shingles")


def region_links(members: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """Links (a, b) whose components are those of all links inside each region; members: region, node, shingles (packed).

    A region above the limit is cut by the counts of its own members first, then by these and by sizes. In what is still
    large a few documents become pivots, every document goes to the cell of its nearest pivot, if any is near, and, as a
    copy, to each cell that may hold a partner of it. Documents linked with a cell's pivot stay in it only as far as some
    other document of the cell may reach them. Cells are cut again, unless they hold more than twice the region; what pivots
    cannot part is joined in pairs of blocks, which finds the same links at more work.
    """
    found, whole = [], []
    weight = F.sum(F.length("shingles") / 8)
    open_rows = members.select(F.col("region").cast("string").alias("region"), "node", "shingles", F.lit(False).alias("settled"))
    for step in range(2 + ROUNDS):
        sizes = open_rows.groupBy("region").agg(weight.alias("weight"))
        large = stored(sizes.filter(F.col("weight") > limit), "large-regions")
        if large.isEmpty():
            break
        small = open_rows.join(large, "region", "left_anti")
        found.append(small.select("region", "node", "shingles"))
        rows = open_rows.join(large, "region", "left_semi")
        if step < 2:
            open_rows = stored(refined(rows, banded=step == 1).withColumn("settled", F.lit(False)), "refined")
            continue
        order = Window.partitionBy("region").orderBy(F.xxhash64("node"), "node")
        picked = rows.filter("NOT settled").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
        pivots = picked.groupBy("region").agg(F.collect_list("node").alias("pivots"), F.collect_list("shingles").alias("pivot_shingles"))
        dealt = salted_join(rows.select("region", "node", "shingles", "settled"), pivots, ["region"], salts=32)
        cells = dealt.select("region", "node", "shingles", "pivots", "pivot_shingles").mapInArrow(_distances, "region string, node long, shingles binary, link long, distance double, settled boolean")
        cells = stored(cells, "cells")
        found.append(cells.filter("link IS NOT NULL").select(F.col("node").alias("a"), F.col("link").alias("b")))
        reach_of = cells.filter("NOT settled").groupBy("region").agg(F.min("distance").alias("nearest"))
        left = salted_join(cells, reach_of, ["region"], salts=32)
        kept = stored(left.filter(~F.col("settled") | (F.col("distance") >= F.col("nearest") - RADIUS - SLACK)).select("region", "node", "shingles", "settled"), "open-cells")
        parent = F.regexp_extract("region", "^(.*)/[^/]*$", 1)
        totals = kept.groupBy(parent.alias("region")).agg(weight.alias("total")).join(large, "region")
        grown = stored(totals.filter(F.col("total") > 2 * F.col("weight")).select("region"), "grown-regions")
        whole.append(rows.select("region", "node", "shingles").join(grown, "region", "left_semi"))
        open_rows = kept.withColumn("__parent", parent).join(grown.withColumnRenamed("region", "__parent"), "__parent", "left_anti").drop("__parent")
    open_rows = open_rows.select("region", "node", "shingles")
    for part in whole:
        open_rows = open_rows.unionByName(part)
    sizes = stored(open_rows.groupBy("region").agg(F.ceil(2 * weight / limit).cast("int").alias("blocks")), "blocks")
    rows = salted_join(open_rows, sizes, ["region"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") <= 2, F.array(F.lit("*"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws("-", F.least(block, j), F.greatest(block, j))))
    paired = rows.select("region", "node", "shingles", F.explode(others).alias("pair"))
    found.append(paired.select(F.concat_ws("|", "region", "pair").alias("region"), "node", "shingles"))
    links = [part if "a" in part.columns else part.groupBy("region").applyInArrow(_join_table, "a long, b long") for part in found]
    out = links[0]
    for part in links[1:]:
        out = out.unionByName(part)
    return out


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packs = [s.tobytes() for _, s in _sets(batch)]
        yield pa.record_batch([*[batch.column(c) for c in ("region", "node", "repeated")], pa.array(packs, pa.binary())], names=["region", "node", "repeated", "shingles"])


def row_key() -> Column:
    """Names a row by its id and its text: a null id and two texts under one id have keys of their own."""
    return F.xxhash64("doc_id", "text")


def linked_rows(docs: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, key, n_shingles, component, component_id of each row; component names the class of a row, with or without
    ids, and is null for a text without words."""
    described = stored(docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(_described, "doc_id long, key long, node long, n_shingles long, n_counted long"), "described")
    regions = components(candidate_edges(docs, described))
    texts = described.filter("node IS NOT NULL").groupBy("node", "key").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("repeated"))
    owner = texts.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("key", "repeated")).alias("text"))
    wanted = owner.join(regions, "node").select("text.*", "node", F.col("component").alias("region"))
    rows = docs.select(row_key().alias("key"), "text").join(wanted, "key").select("region", "node", "repeated", "text")
    packed = stored(rows.mapInArrow(_packed_sets, "region long, node long, repeated boolean, shingles binary"), "members")
    again = packed.filter("repeated").groupBy("region", "node").agg(F.first("shingles").alias("shingles"))
    members = packed.filter("NOT repeated").select("region", "node", "shingles").unionByName(again)
    links = components(region_links(members, limit))
    least = owner.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(least.select("node", "component"), heads, ["component"]).select("node", "component", "component_id")
    columns = ["doc_id", "key", "n_shingles", "component", "component_id"]
    full = salted_join(described.filter("node IS NOT NULL"), named, ["node"]).select(*columns)
    alone = described.filter("node IS NULL").withColumns({"component": F.col("node"), "component_id": F.col("doc_id")})
    return full.unionByName(alone.select(*columns))


def first_copies(docs: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, a null id last. Of rows that repeat id and text the
    one whose other columns are smallest stays. Texts without words have no component and all stay."""
    rows = linked_rows(docs, limit)
    texts = rows.filter("component IS NOT NULL").groupBy("component", "doc_id", "key").agg((F.count("*") > 1).alias("repeated"))
    firsts = texts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "repeated")).alias("first"))
    alone = rows.filter("component IS NULL").select("key", F.lit(False).alias("repeated")).distinct()
    kept = stored(firsts.select("first.key", "first.repeated").unionByName(alone), "first-copies")
    keyed = docs.withColumn("__key", row_key())
    pick = lambda rows: keyed.join(kept.filter(rows).select(F.col("key").alias("__key")), "__key", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = pick("repeated").groupBy("__key").agg(F.min(F.struct(*others, "doc_id", "text")).alias("__row"))
    return pick("NOT repeated").select(*docs.columns).unionByName(again.select("__row.*").select(*docs.columns))


def near_duplicates(docs: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least 0.8 likeness, itself included).

    Words are lower-cased by A-Z only. A text without words has an empty set and no link; a text of fewer than five words is
    one shingle. Equal sets are one node (named by 64 bits), so copies cost one row each. Rows that repeat a doc_id are rows
    of their own, with the links of their own text; so are rows with a null id, which link others but name a component only
    where none of its rows has an id: then it is null. An empty table gives no rows.
    """
    return linked_rows(docs, limit).select("doc_id", "n_shingles", "component_id")
