"""Append-only JSON-lines logs: review decisions and agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.functions.scoring import label_for

# The label each review action carries into the training set.
ACTION_LABELS = {"ship": 0, "scrap": 1, "senior_review": None}

LABEL_COLUMNS = ("part_id", "action", "label", "at")
DECISION_NUMBER = "decision_id"
DECISION_SCHEMA = "part_id long, action string, label int, at string"
TRACE_SCHEMA = ("at string, event string, task string, tool string, spent_usd double, status string, "
                "result struct<lift: double, shuffled_lift: double, collapse: double>")


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed scan of a JSON-lines log. `log` is the file name without its extension.

    (block, pos) is the place of a line in its file: where the split that holds it begins, and a number that grows along the
    lines a task reads. Only the order of the places has a meaning; it holds however a file is split. `fields` is the whole
    line as a VARIANT, so fields that the schema does not name stay. A line that is no JSON object has nulls in all of them
    and itself in `damaged`; `sound` and `damaged` part the two. Blank lines are no lines.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    placed = lines.select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", "").alias("log"),
                          F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    parsed = placed.withColumn("fields", F.try_parse_json("value"))
    good = F.coalesce(F.startswith(F.schema_of_variant("fields"), F.lit("OBJECT")), F.lit(False))
    typed = F.when(good, F.from_json("value", schema)).alias("row")
    return (parsed.select(typed, "log", "block", "pos", F.when(good, F.col("fields")).alias("fields"), F.when(~good, F.col("value")).alias("damaged"))
            .select("row.*", "log", "block", "pos", "fields", "damaged"))


def sound(log: DataFrame) -> DataFrame:
    """The lines that could be read."""
    return log.where(F.col("damaged").isNull()).drop("damaged")


def damaged(log: DataFrame) -> DataFrame:
    """(log, block, pos, damaged): the lines that could not be read, with their places."""
    return log.where(F.col("damaged").isNotNull()).select("log", "block", "pos", "damaged")


def field(path: str, kind: str) -> Column:
    """A field of a log line that its schema need not name; null where it is absent or of another kind."""
    return F.try_variant_get("fields", path, kind)


def labelled(decisions: DataFrame) -> DataFrame:
    """Decisions with the label of their action and a timestamp; further columns follow."""
    more = [c for c in decisions.columns if c not in LABEL_COLUMNS]
    return decisions.select("part_id", "action", label_for(F.col("action"), ACTION_LABELS).alias("label"), "at", *more)


def append_label(decisions: DataFrame, path: str) -> None:
    """Append (part_id, action, at) decisions with their labels and, where they have one, their decision_id; existing lines
    are never rewritten."""
    number = [c for c in (DECISION_NUMBER,) if c in decisions.columns]
    labelled(decisions).select(*LABEL_COLUMNS, *number).write.mode("append").option("ignoreNullFields", False).json(path)


def labelled_only(decisions: DataFrame) -> DataFrame:
    """Confirmed labels; senior reviews carry none."""
    return decisions.where(F.col("label").isNotNull())
