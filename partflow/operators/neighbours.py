"""Exact k nearest past parts for a whole queue, without comparing every pair on a route.

Brute force compares each queued part with every train part of its route, which is quadratic on a hot route. Here the
train parts of every route are cut into a ball tree that is held as tables:

1. a node of too many parts is cut at the medians of its widest directions, as a bounded sample of it shows them; every
   part then descends by comparing numbers, and the next level does the same where a node is still too large;
2. each leaf is one row of points with its centre and radius, each node above it a centre and radius that cover it;
3. queued parts descend as well and form blocks; the k-th distance in a block's own leaf bounds its answer;
4. a block descends the tree again and meets only the balls within its bound, and a block meets a leaf as one matrix
   product whose close pairs are then measured exactly, so only possible answers leave the task.

Balls never exclude a true neighbour, so the result equals brute force, ties included. A part whose route has fewer than
k train parts searches all of train through the same structure, built once more over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.scoring import hash_number
from partflow.session import materialized

LEAF_ROWS = 256
_CUTS, _SAMPLE, _DEPTH = 6, 2048, 9  # binary cuts a level, parts a node that show where to cut, levels at most
_FAN = 1 << _CUTS
_TIE_DIGITS = 9  # distances equal to this many decimals are ties, decided by id
_SLACK = 1e-9  # relative widening of bounds against rounding


def column_moments(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, std): population deviation over present values, 1 where it is zero or undefined."""
    packed = train.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}.mean").alias("mean"),
                                 F.when(F.col(f"{c}.std") > 0, F.col(f"{c}.std")).otherwise(1.0).alias("std"))
                        for c in columns])
    return packed.select(F.explode(entries).alias("e")).select("e.name", "e.mean", "e.std")


def standardize(df: DataFrame, moments: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """z, an array in the order of columns, by the train moments; a missing value becomes 0, the mean. The moments are one
    row per column."""
    packed = moments.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "std")))).alias("m"))
    ordered = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.col("m")[c])
    lookup = packed.select(ordered.alias("m")).scalar()
    values = F.array(*[F.col(c).cast("double") for c in columns])
    z = F.zip_with("__v", "__m", lambda v, m: F.coalesce((v - m["mean"]) / m["std"], F.lit(0.0)))
    return df.select(*keep, values.alias("__v"), lookup.alias("__m")).select(*keep, z.alias("z"))


# ---- the tree as tables

def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of an array column as a matrix."""
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _cut(z: np.ndarray, levels: int) -> tuple[list[int], list[float]]:
    """Direction and border of each inner place of a binary tree, in heap order. Places without a use send all to the left."""
    dims, cuts = [0] * (_FAN - 1), [float("inf")] * (_FAN - 1)
    open_places = [(0, np.arange(len(z)), 0)]
    while open_places:
        place, rows, depth = open_places.pop()
        low, high = z[rows].min(axis=0), z[rows].max(axis=0)
        widest = int((high - low).argmax())
        if depth == levels or high[widest] == low[widest]:
            continue
        values = z[rows, widest]
        border = np.median(values)
        if border == low[widest]:
            border = values[values > border].min()
        dims[place], cuts[place] = widest, float(border)
        right = values >= border
        open_places += [(2 * place + 1, rows[~right], depth + 1), (2 * place + 2, rows[right], depth + 1)]
    return dims, cuts


def _cutter(leaf_rows: int) -> Callable[[pa.Table], pa.Table]:
    def run(node: pa.Table) -> pa.Table:
        size = node.column("n")[0].as_py()
        dims, cuts = _cut(_matrix(node.column("z")), min(_CUTS, max(1, int(np.ceil(np.log2(size / leaf_rows))))))
        return pa.table({"grp": node.column("grp").slice(0, 1), "node": node.column("node").slice(0, 1), "dims": pa.array([dims], pa.list_(pa.int32())), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    return run


def _descended(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with the node one level down; a node without cuts has one child."""
    place = F.expr(f"aggregate(sequence(1, {_CUTS}), 0, (h, i) -> 2 * h + 1 + if(z[dims[h]] >= cuts[h], 1, 0)) - {_FAN - 1}")
    child = F.col("node") * _FAN + F.when(F.col("dims").isNull(), 0).otherwise(place)
    return rows.join(cuts, ["grp", "node"], "left").withColumn("node", child).drop("dims", "cuts")


def _ball(points: np.ndarray, radii: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    return centre, float((np.sqrt(((points - centre) ** 2).sum(axis=1)) + radii).max()) * (1 + _SLACK)


_POINTS = "grp string, node long, {extra}ids array<long>, {ys}points array<double>, centre array<double>, radius double, n long"


def _packed(key: Sequence[str], ys: bool) -> Callable[[pa.Table], pa.Table]:
    """A group of points as one row."""

    def run(group: pa.Table) -> pa.Table:
        z = _matrix(group.column("z"))
        centre, radius = _ball(z)
        out = {k: group.column(k).slice(0, 1) for k in key} | {"ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64()))}
        if ys:
            out["ys"] = pa.array([group.column("y").to_pylist()], pa.list_(pa.int32()))
        return pa.table(out | {"points": pa.array([z.ravel()], pa.list_(pa.float64())), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": pa.array([radius]), "n": pa.array([len(z)])})

    return run


def _covering(group: pa.Table) -> pa.Table:
    """The ball around the balls of a node's children."""
    centre, radius = _ball(_matrix(group.column("centre")), group.column("radius").to_numpy())
    return pa.table({"grp": group.column("grp").slice(0, 1), "node": group.column("above").slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": pa.array([radius])})


def ball_tree(train: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(cuts a level, balls a level) of train (grp, id, y, z), top first; the last level of balls holds the points.

    A level's cuts are one row a node, found on at most 2,048 of its parts; every part is then placed by them.
    """
    rows, cuts = train.withColumn("node", F.lit(0).cast("long")), []
    while len(cuts) < _DEPTH:
        large = materialized(rows.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows))
        if large.isEmpty():
            break
        pick = Window.partitionBy("grp", "node").orderBy(hash_number(F.col("id"), F.lit(len(cuts))), "id")
        shown = rows.join(large, ["grp", "node"]).withColumn("__pick", F.row_number().over(pick)).where(F.col("__pick") <= _SAMPLE)
        cuts.append(materialized(shown.select("grp", "node", "n", "z").groupBy("grp", "node").applyInArrow(_cutter(leaf_rows), "grp string, node long, dims array<int>, cuts array<double>")))
        rows = materialized(_descended(rows, cuts[-1]))
    packed = rows.groupBy("grp", "node").applyInArrow(_packed(("grp", "node"), True), _POINTS.format(extra="", ys="ys array<int>, "))
    levels = [materialized(packed)]
    for _ in cuts:
        children = levels[0].select("grp", F.expr(f"node DIV {_FAN}").alias("above"), "centre", "radius")  # at most 64 a node
        levels.insert(0, materialized(children.groupBy("grp", "above").applyInArrow(_covering, "grp string, node long, centre array<double>, radius double")))
    return cuts, levels


# ---- the search

def _exact(queued: np.ndarray, points: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queued, point, squared distance) of the k closest points within its bound of each queued one, ties by id.

    The matrix product only rules pairs out; those it leaves are measured by their differences.
    """
    near = (queued**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * queued @ points.T
    scale = np.abs(queued).max(initial=0) + np.abs(points).max(initial=0)
    at, to = np.nonzero(near <= (bounds**2)[:, None] + 1e-10 * (1 + scale * scale * points.shape[1]))
    d2 = np.concatenate([((queued[at[i : i + 65536]] - points[to[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(at), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[to], np.round(np.sqrt(d2), _TIE_DIGITS), at))
    at, to, d2 = at[order], to[order], d2[order]
    first = np.searchsorted(at, np.arange(len(queued)))
    keep = np.arange(len(at)) - first[at] < k
    return at[keep], to[keep], d2[keep]


def _lists(row: pa.Table, *names: str) -> list[np.ndarray]:
    return [row.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names]


def _bounding(k: int) -> Callable[[pa.Table], pa.Table]:
    """The k-th distance of each queued part in its own leaf, a little widened; none where the leaf is too small."""

    def run(row: pa.Table) -> pa.Table:
        queued, points = _lists(row, "points", "leaf")
        dims = len(row.column("centre")[0])
        queued, points = queued.reshape(-1, dims), points.reshape(-1, dims)
        bounds = np.full(len(queued), np.inf)
        if len(points) >= k:
            near = np.sqrt(np.maximum((queued**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * queued @ points.T, 0))
            closest = np.argpartition(near, k - 1, axis=1)[:, :k]
            bounds = np.sqrt(((queued[:, None, :] - points[closest]) ** 2).sum(axis=2)).max(axis=1) * (1 + _SLACK) + 2.0 * 10.0**-_TIE_DIGITS
        return row.drop_columns(["leaf"]).append_column("bounds", pa.array([bounds], pa.list_(pa.float64()))).append_column("bound", pa.array([float(bounds.max())]))

    return run


def _meeting(k: int) -> Callable[[pa.Table], pa.Table]:
    """Those of a block of queued parts that reach a leaf, against the leaf."""

    def run(row: pa.Table) -> pa.Table:
        qids, queued, bounds, ids, ys, points = _lists(row, "qids", "queued", "bounds", "ids", "ys", "points")
        queued, points = queued.reshape(len(qids), -1), points.reshape(len(ids), -1)
        at, to, d2 = _exact(queued, points, ids, bounds, k)
        return pa.table({"qid": pa.array(qids[at], pa.int64()), "id": pa.array(ids[to], pa.int64()), "y": pa.array(ys[to], pa.int32()), "d2": pa.array(d2)})

    return run


def leaf_visits(queue: DataFrame, train: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, blocks, leaves): which leaves the blocks of queued parts (qid, grp, z) have to meet.

    visits: grp, home, part, node, parts (points of the leaf) and reached, the places in the block whose own bound reaches
    the leaf's ball. Descending the tree a block goes by its widest bound; at a leaf each queued part goes by its own.
    """
    leaf_rows = max(leaf_rows, 2 * k)
    cuts, levels = ball_tree(train, leaf_rows)
    placed = queue.select("grp", F.col("qid").alias("id"), "z").withColumn("node", F.lit(0).cast("long"))
    for level in cuts:
        placed = _descended(placed, level)
    placed = materialized(placed)
    shares = placed.groupBy("grp", "node").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("__parts"))
    placed = placed.join(shares, ["grp", "node"]).withColumn("part", F.pmod(hash_number(F.col("id"), F.lit(0)), F.col("__parts")))
    key = ("grp", "node", "part")
    packed = placed.groupBy(*key).applyInArrow(_packed(key, False), _POINTS.format(extra="part long, ", ys=""))
    kinds = _POINTS.format(extra="part long, ", ys="") + ", bounds array<double>, bound double"
    own = levels[-1].select("grp", "node", F.col("points").alias("leaf"))
    blocks = materialized(packed.join(own, ["grp", "node"], "left").groupBy(*key).applyInArrow(_bounding(k), kinds))
    reach = blocks.select("grp", F.col("node").alias("home"), "part", F.col("n").alias("queued"), F.col("centre").alias("c"), F.col("radius").alias("r"), "bound", F.lit(0).cast("long").alias("node"))
    for depth, level in enumerate(levels):
        nodes = level.select("grp", F.expr(f"node DIV {_FAN if depth else 1}").alias("above"), F.col("node").alias("below"), "centre", "radius", *(["n"] if level is levels[-1] else []))
        gap = F.sqrt(F.aggregate(F.zip_with("c", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) * (1 - _SLACK)
        met = reach.withColumnRenamed("node", "above").join(nodes, ["grp", "above"]).where(gap <= F.col("r") + F.col("radius") + F.col("bound"))
        reach = met.select("grp", "home", "part", "queued", "c", "r", "bound", F.col("below").alias("node"), *(["n"] if level is levels[-1] else []))
    d = "size(centre)"
    gap = f"sqrt(aggregate(zip_with(slice(points, CAST(i * {d} + 1 AS INT), {d}), centre, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)) * {1 - _SLACK}"
    balls = levels[-1].select("grp", "node", "centre", "radius", F.col("n").alias("parts"))
    met = (reach.select("grp", "home", "part", "node", "queued").join(blocks.select("grp", F.col("node").alias("home"), "part", "points", "bounds"), ["grp", "home", "part"])
           .join(balls, ["grp", "node"]).withColumn("reached", F.expr(f"filter(sequence(0, CAST(queued AS INT) - 1), i -> {gap} <= radius + bounds[i])")))
    return met.where(F.size("reached") > 0).select("grp", "home", "part", "node", "parts", "reached"), blocks, levels[-1]


def _sent(met: DataFrame) -> DataFrame:
    """Visits with those queued parts of the block that reach the leaf: the others need not move to it."""
    d = "CAST(size(queued) DIV size(qids) AS INT)"
    return met.select("grp", "home", "part", "node", F.expr("transform(reached, i -> qids[i])").alias("qids"), F.expr("transform(reached, i -> bounds[i])").alias("bounds"),
                      F.expr(f"flatten(transform(reached, i -> slice(queued, CAST(i * {d} + 1 AS INT), {d})))").alias("queued"))


def _search(queue: DataFrame, train: DataFrame, k: int, leaf_rows: int) -> DataFrame:
    """Rows (qid, id, y, d2) that hold the k closest train parts of each queued one; both sides carry grp and z."""
    visits, blocks, leaves = leaf_visits(queue, train, k, leaf_rows)
    queued = blocks.select("grp", F.col("node").alias("home"), "part", F.col("ids").alias("qids"), F.col("points").alias("queued"), "bounds")
    met = _sent(visits.select("grp", "home", "part", "node", "reached").join(queued, ["grp", "home", "part"]))
    met = met.join(leaves.select("grp", "node", "ids", "ys", "points"), ["grp", "node"])
    return met.groupBy("grp", "home", "part", "node").applyInArrow(_meeting(k), "qid long, id long, y int, d2 double")


def k_nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k closest per queued part, ties by id. Spark limits each group to k rows before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.round(F.sqrt("d2"), _TIE_DIGITS), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _thinned(train: DataFrame, k: int) -> DataFrame:
    """At most k parts per distinct point of a group, lowest ids first: no answer can hold more of them.

    A third of all parts may be identical. Spark limits each point to k rows before the shuffle, so such a point
    costs k rows per task, and a search near it meets k parts instead of all of them.
    """
    order = Window.partitionBy("grp", "z").orderBy("id")
    return train.withColumn("__copy", F.row_number().over(order)).where(F.col("__copy") <= k).drop("__copy")


def _nearest_in(queue: DataFrame, train: DataFrame, k: int, leaf_rows: int) -> DataFrame:
    """(qid, id, y, d2, rank) for a queue whose candidates share its grp. Equal queued points search once."""
    point = ["grp", "z"]
    first = materialized(queue.groupBy(*point).agg(F.min("qid").alias("qid")))
    found = k_nearest(_search(first, _thinned(train, k), k, leaf_rows), k).withColumnRenamed("qid", "rep")
    members = queue.select("qid", *point).join(first.withColumnRenamed("qid", "rep"), point).select("qid", "rep")
    return members.join(found, "rep").drop("rep")


def knn_join(queue: DataFrame, train: DataFrame, columns: Sequence[str], k: int = 20,
             leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(part_id, neighbour_id, response, distance, rank, same_route) for every queued part.

    queue(part_id, route, columns...), train(id, y, route, columns...).
    """
    moments = column_moments(train, columns)
    t = materialized(standardize(train, moments, columns, ["id", "y", "route"]))
    q = standardize(queue, moments, columns, ["part_id", "route"]).withColumnRenamed("part_id", "qid")
    sizes = t.groupBy("route").agg(F.count(F.lit(1)).alias("route_parts"))
    total = t.agg(F.count(F.lit(1)).alias("n")).scalar()
    route_parts = F.coalesce("route_parts", F.lit(0))
    placed = materialized(q.join(sizes, "route", "left").select(
        "qid", "route", "z", (route_parts >= k).alias("own"), ((route_parts >= k) & (route_parts < total)).alias("same_route")))
    nearest = _nearest_in(placed.where("own").select("qid", F.col("route").alias("grp"), "z"),
                          t.withColumnRenamed("route", "grp"), k, leaf_rows)
    rest = placed.where(~F.col("own")).select("qid", F.lit("*").alias("grp"), "z")
    if not rest.isEmpty():
        everywhere = t.drop("route").withColumn("grp", F.lit("*"))
        nearest = nearest.unionByName(_nearest_in(rest, everywhere, k, leaf_rows))
    return (nearest.join(placed.select("qid", "same_route"), "qid")
            .select(F.col("qid").alias("part_id"), F.col("id").alias("neighbour_id"), F.col("y").cast("int").alias("response"),
                    F.round(F.sqrt("d2"), 4).alias("distance"), F.col("rank").cast("int").alias("rank"), "same_route"))


def neighbour_records(matches: DataFrame) -> DataFrame:
    """One record per queued part: its neighbours in order, how many failed, how many there are."""
    entry = F.struct("rank", "neighbour_id", "response", "distance")
    return (matches.groupBy("part_id", "same_route")
            .agg(F.array_sort(F.collect_list(entry)).alias("neighbours"),  # at most k entries
                 F.sum("response").alias("failed"), F.count(F.lit(1)).alias("k")))


def failed_neighbours(matches: DataFrame) -> DataFrame:
    return matches.groupBy("part_id", "same_route").agg(F.sum("response").alias("failed"), F.count(F.lit(1)).alias("k"))
