"""Streams over the append-only inputs: scored parts to be routed, review decisions to be labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partflow.functions.scoring import label_for, route_decision
from partflow.session import scratch_path
from partflow.sources.logs import ACTION_LABELS, DECISION_NUMBER, DECISION_SCHEMA

DELIVERY = ("part_id", "action", "at", DECISION_NUMBER)  # what two deliveries of one decision share


def route_stream(scores: DataFrame, band_low: float, band_high: float) -> DataFrame:
    """Decision per arriving part: stateless, so it scales with the input partitions."""
    return scores.withColumn("decision", route_decision(F.col("p"), F.lit(float(band_low)), F.lit(float(band_high))))


def decision_source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines decision files as they land; a line without a decision_id has null there."""
    return (spark.readStream.schema(f"{DECISION_SCHEMA}, {DECISION_NUMBER} long").option("maxFilesPerTrigger", files_per_trigger).json(path)
            .withColumn("at", F.to_timestamp("at")))


def label_stream(decisions: DataFrame, remember: str = "7 days") -> DataFrame:
    """Every decision once, with its label, however late it comes.

    A delivery of the same part, action, time and decision_id is a repeat and is dropped for `remember` after the first one,
    across restarts. Times have whole seconds, so only the decision_id tells two equal decisions of one second apart; without
    it they count as one. The state is keyed by these four and expires by the time of arrival, not by that of the decision, so no late
    decision is dropped and the state holds at most the decisions that arrived within `remember`. Two actions on one part in
    the same second are two decisions.
    """
    labels = decisions.select("part_id", "action", label_for(F.col("action"), ACTION_LABELS).alias("label"), "at", *[c for c in (DECISION_NUMBER,) if c in decisions.columns])
    arrived = labels.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remember)
    return arrived.dropDuplicatesWithinWatermark([c for c in DELIVERY if c in decisions.columns]).drop("arrived")


def each_once(labels: DataFrame) -> DataFrame:
    """Written labels without repeats that came later than the stream remembers."""
    return labels.dropDuplicates([c for c in DELIVERY if c in labels.columns])


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly-once append to Parquet files; the checkpoint lets a restarted job continue where it stopped."""
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(path))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available now and return the written rows as a table."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
