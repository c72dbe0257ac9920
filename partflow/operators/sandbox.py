"""User-defined features: one split, labels removed, ids bound plainly, shuffled or on a subset of parts."""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from partflow.functions.scoring import hash_number, seeded_below
from partflow.operators.ranking import row_numbers
from partflow.operators.splits import first_rows
from partflow.session import materialized
from partflow.sources.catalog import ID, LABEL

# The view names and modes that proposed features are written for.
VIEWS = {"numeric": "parts_numeric", "date": "parts_date", "categorical": "parts_categorical"}
MODES = ("plain", "shuffled", "subset")
NAME_RULE = re.compile(r"^[a-z][a-z0-9_]{0,62}$")  # fixed pattern of a feature name
MAX_NEW_COLUMNS = 300
SEED = 17


class FeatureError(ValueError):
    """A feature is malformed or does not return one row per part."""


@dataclass(frozen=True)
class FeatureDef:
    """A feature: SQL text over the parts_* views, or a function of those views."""

    name: str
    hypothesis: str
    sql: str = ""
    build: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None

    def __post_init__(self) -> None:
        if not NAME_RULE.match(self.name):
            raise FeatureError(f"feature name {self.name!r} must be snake_case")
        if not self.hypothesis.strip():
            raise FeatureError("a hypothesis is required")
        if bool(self.sql) == (self.build is not None):
            raise FeatureError("give either SQL or a function")

    @property
    def feature_id(self) -> str:
        return "f_" + hashlib.sha256(f"{self.name}\n{self.sql}".encode()).hexdigest()[:10]


def propose(log: DataFrame, features: Sequence[FeatureDef], proposed_by: str) -> DataFrame:
    """Rows to append to the proposal log; a feature already in it is not proposed again."""
    rows = [(f.feature_id, f.name, f.hypothesis.strip(), f.sql, proposed_by, "proposed") for f in features]
    schema = "feature_id string, name string, hypothesis string, sql string, proposed_by string, status string"
    offered = log.sparkSession.createDataFrame(rows, schema).dropDuplicates(["feature_id"])
    return offered.join(log.select("feature_id"), "feature_id", "left_anti")


def zip_by_rank(a: DataFrame, b: DataFrame, a_order: Sequence, b_order: Sequence) -> DataFrame:
    """Pair the rows of two tables by position in their own orders; both ranks are distributed."""
    left, right = row_numbers(a, a_order, "__r"), row_numbers(b, b_order, "__r")
    return left.join(right, "__r").drop("__r")


def id_map(ids: DataFrame, mode: str = "plain", seed: int = SEED, fraction: float = 0.5) -> DataFrame:
    """(Id, bound_id): each real part and the id it shows to feature code.

    'shuffled' is a seeded permutation of the ids themselves: by Id on one side, by a keyed digest on the other.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    ids = ids.select(ID)
    if mode == "plain":
        return ids.withColumn("bound_id", F.col(ID))
    if mode == "subset":
        return ids.where(seeded_below(F.col(ID), seed, fraction)).withColumn("bound_id", F.col(ID))
    shown = ids.select(F.col(ID).alias("bound_id"))
    keyed = shown.withColumn("__k", hash_number(F.col("bound_id"), F.lit(seed)))
    return zip_by_rank(ids, keyed, [ID], ["__k", "bound_id"]).select(ID, "bound_id")


def bind_ids(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """The table as feature code sees it: real Ids replaced by bound ones, labels removed."""
    return (table.drop(LABEL).join(mapping, ID).drop(ID).withColumnRenamed("bound_id", ID)
            .select(ID, *[c for c in table.columns if c not in (ID, LABEL)]))


_NAMES = threading.RLock()


@contextmanager
def shown_as(views: Mapping[str, DataFrame]) -> Iterator[SparkSession]:
    """The session with the frames under these view names. One user at a time; a view of the caller's that had such a name
    is back afterwards."""
    spark: SparkSession = next(iter(views.values())).sparkSession
    with _NAMES:
        taken = {t.name for t in spark.catalog.listTables() if t.isTemporary} & set(views)
        before = {name: spark.table(name) for name in taken}
        try:
            for name, frame in views.items():
                frame.createOrReplaceTempView(name)
            yield spark
        finally:
            for name in views:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


def run_feature(feature: FeatureDef, views: Mapping[str, DataFrame]) -> DataFrame:
    """Resolve a feature against its views. SQL is analysed right here, so the views can be dropped after."""
    if feature.build is not None:
        out = feature.build(views)
    else:
        try:
            with shown_as({VIEWS[kind]: view for kind, view in views.items()}) as spark:
                out = spark.sql(feature.sql)
                out.schema  # noqa: B018 - force analysis while the views exist
        except AnalysisException as exc:
            raise FeatureError(f"feature {feature.name} does not run: {exc}") from exc
    if ID not in out.columns or len(out.columns) < 2:
        raise FeatureError("a feature must return Id and at least one column")
    return out


def one_row_per_part(frame: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: parts expected, rows given, and how many parts are missing, repeated or foreign.

    A full outer join of counts per id, so repeated ids are counted where they are and never gathered.
    """
    given = frame.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    expected = mapping.select(F.col("bound_id").alias(ID), F.lit(True).alias("expected"))
    both = given.join(expected, ID, "full_outer")
    return both.agg(
        F.count_if(F.col("expected")).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("expected").isNull()).alias("foreign")
    ).withColumn("valid", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("foreign") == 0))


def compute_feature(feature: FeatureDef, tables: Mapping[str, DataFrame], mapping: DataFrame,
                    check: bool = True) -> DataFrame:
    """The feature's columns on real Ids, one row per part of the split, or FeatureError.

    The result is fixed by a checkpoint, so the check and the later tests read the same rows once.
    """
    views = {kind: bind_ids(table, mapping) for kind, table in tables.items()}
    shown = run_feature(feature, views)
    if check:
        shown = materialized(shown)
        found = one_row_per_part(shown, mapping).first()
        if not found.valid:
            raise FeatureError(f"{feature.name} must return one row per part: {found.rows} rows for {found.parts} parts, "
                               f"{found.missing} missing, {found.repeated} repeated, {found.foreign} foreign")
    renamed = shown.withColumnRenamed(ID, "bound_id").join(mapping, "bound_id").drop("bound_id")
    return renamed.select(ID, *[c for c in shown.columns if c != ID])


def compare_frames(full: DataFrame, part: DataFrame) -> DataFrame:
    """Parts whose values differ between two computations, null- and NaN-safe: compared, mismatched, share."""
    columns = [c for c in part.columns if c != ID]
    kinds = dict(part.dtypes)

    def plain(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(ID, *[
            (F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`"))
            .alias(f"{prefix}{i}") for i, c in enumerate(columns)])

    joined = plain(part, "b").join(plain(full, "a"), ID)
    changed = F.lit(False)
    for i in range(len(columns)):
        changed = changed | ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
    return joined.agg(F.count(F.lit(1)).alias("rows_compared"), F.count_if(changed).alias("mismatched")).withColumn(
        "mismatch_share", F.col("mismatched") / F.greatest(F.lit(1), F.col("rows_compared")))


def align_labels(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined on by Id, outside the reach of feature code."""
    return frame.join(labels.select(ID, LABEL), ID)


def feature_columns_for(base: DataFrame, frames: Mapping[str, DataFrame], max_columns: int = MAX_NEW_COLUMNS) -> DataFrame:
    """Base features plus every frame's columns as fx_{name}__{column}; every part must be covered."""
    added = sum(len(f.columns) - 1 for f in frames.values())
    if added > max_columns:
        raise FeatureError(f"{added} new columns exceed the limit of {max_columns}")
    out = base
    for name, frame in frames.items():
        renamed = frame.select(ID, *[F.col(f"`{c}`").alias(f"fx_{name}__{c}") for c in frame.columns if c != ID])
        out = out.join(renamed, ID, "left")
    return out


def coverage_gap(base: DataFrame, frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, missing): parts of the base that a frame does not cover; all zero when the frames fit."""
    rows = None
    for name, frame in frames.items():
        gap = base.select(ID).join(frame.select(ID), ID, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        gap = gap.select(F.lit(name).alias("name"), "missing")
        rows = gap if rows is None else rows.unionByName(gap)
    return rows


def feature_status(decisions: DataFrame, decider: str = "warden") -> DataFrame:
    """Status per feature from the decision log (feature_id, name, actor, status, finding, at).

    Only the decider's rows count, each needs a finding, and one quarantine is final. No ordering is needed
    for the absorbing state, so the aggregation combines map-side.
    """
    counted = decisions.where((F.col("actor") == decider) & (F.length(F.trim("finding")) > 0)
                              & F.col("status").isin("approved", "quarantined"))
    known = decisions.groupBy("feature_id", "name").agg(F.count(F.lit(1)).alias("__all"))
    decided = counted.groupBy("feature_id", "name").agg(
        F.count(F.lit(1)).alias("decisions"), F.bool_or(F.col("status") == "quarantined").alias("__q"),
        F.max_by("status", "at").alias("__latest"))
    status = F.when(F.col("__q"), "quarantined").otherwise(F.coalesce("__latest", F.lit("proposed")))
    return (known.join(decided, ["feature_id", "name"], "left")
            .select("feature_id", "name", status.alias("status"), F.coalesce("decisions", F.lit(0)).alias("decisions")))


def explore(tables: Mapping[str, DataFrame], labels: DataFrame, sql: str, rows: int | None = None) -> DataFrame:
    """A read-only query over the train views, with labels visible as parts_labels: the whole result, or a page of rows."""
    views = {VIEWS[kind]: table.drop(LABEL) for kind, table in tables.items()} | {"parts_labels": labels.select(ID, LABEL)}
    with shown_as(views) as spark:
        found = spark.sql(sql)
        return found if rows is None else first_rows(found, rows)
