"""Summaries of agent traces, decisions and evaluations.

Traces are rows (log, block, pos, at, event, ...) in the order of their lines; stamps have whole seconds and a clock may go
back, so they order nothing. A busy agent may own a third of all rows, so runs are numbered by a distributed running total
along (log, block, pos) instead of a window per agent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partflow.operators.ranking import running_totals

# The stamp that ends a log name, the log that holds no spend, the end events of a search.
LOG_STAMP = r"-[0-9T]+Z?$"
REFUSAL_LOG = "refusals"
END_EVENTS = ("agent_end", "budget_stop")
LINE_ORDER = ("block", "pos")


def agent_name(log: Column) -> Column:
    return F.regexp_replace(log, LOG_STAMP, "")


def of_agent(traces: DataFrame, agent: str | None, source: str = "log") -> DataFrame:
    """The logs of one agent, whose names are the agent's and a stamp; all logs without an agent."""
    return traces if agent is None else traces.where(F.col(source).startswith(f"{agent}-"))


def run_groups(traces: DataFrame, source: str = "log", order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """Add `run`: it grows at each agent_start of a source. Rows before the first start form a run of their own.

    The total runs over all sources together; a run is identified by (source, run), so it needs no reset.
    """
    marked = traces.withColumn("__start", (F.col("event") == "agent_start").cast("long"))
    return running_totals(marked, [source, *order], {"run": "__start"}).drop("__start")


def run_spend(traces: DataFrame, source: str = "log", order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """Peak spend of each run; a run without a model turn spent nothing."""
    spent = F.when(F.col("event") == "model_turn", F.coalesce("spent_usd", F.lit(0.0)))
    return (run_groups(traces, source, order).groupBy(source, "run")
            .agg(F.greatest(F.coalesce(F.max(spent), F.lit(0.0)), F.lit(0.0)).alias("peak_usd")))


def spend_by_agent(traces: DataFrame, source: str = "log", order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """(agent, spent_usd): peaks of runs summed per agent. Refusal logs carry no spend."""
    used = traces.where(F.col(source) != REFUSAL_LOG)
    return (run_spend(used, source, order).groupBy(agent_name(F.col(source)).alias("agent"))
            .agg(F.sum("peak_usd").alias("spent_usd")))


def total_spend(by_agent: DataFrame) -> DataFrame:
    return by_agent.agg(F.coalesce(F.sum("spent_usd"), F.lit(0.0)).alias("total_usd"))


def survival(status: DataFrame) -> DataFrame:
    """Approved among decided proposals, and how many are quarantined. status(feature_id, name, status)."""
    decided = status.where(F.col("status") != "proposed")
    return decided.agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count(F.lit(1)).alias("decided"),
                       F.count_if(F.col("status") == "quarantined").alias("quarantined")).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("approved").cast("double"), F.col("decided")), F.lit(0.0)))


def quarantined_names(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "quarantined").select("name")


def disposition_facts(traces: DataFrame, agent: str | None = None) -> DataFrame:
    """Disposition outcomes and how many were rejected for fabricated citations, in the logs of an agent or in all."""
    outcome = F.col("event") == "disposition_outcome"
    return of_agent(traces, agent).agg(F.count_if(outcome).alias("dispositions"),
                      F.count_if(outcome & (F.col("status") == "rejected")).alias("fabricated_citations"))


def leak_lift(traces: DataFrame, feature: str, tool: str = "id_shuffle_test", source: str = "log",
              order: Sequence[str] = LINE_ORDER, agent: str | None = None) -> DataFrame:
    """First shuffle-test result of the named feature in the newest log that has one, by stamp; at most one row.

    Only the logs of the agent count, if one is named. Logs of one stamp go by name.
    The task of a run is read off its start row and met again by (source, run): no window over a log.
    """
    runs = run_groups(of_agent(traces, agent, source), source, order)
    named = (runs.where((F.col("event") == "agent_start") & F.col("task").contains(f"'{feature}'"))
             .select(source, "run"))
    hits = runs.where((F.col("event") == "tool_result") & (F.col("tool") == tool)).join(named, [source, "run"], "left_semi")
    first = F.struct(F.col(source), *[F.col(o) for o in order])
    newest = hits.agg(F.max_by(source, F.struct(F.regexp_extract(source, LOG_STAMP, 0), source)).alias("s")).scalar()
    return (hits.where(F.col(source) == newest).agg(F.min_by("result", first).alias("r"), F.first(source).alias("log"))
            .where(F.col("r").isNotNull()).select("log", "r.lift", "r.shuffled_lift"))


def spend_per_point(facts: DataFrame) -> DataFrame:
    """Spend per MCC point gained; null when nothing was gained. facts(spent_usd, reference_mcc, best_mcc)."""
    gain = (F.col("best_mcc") - F.col("reference_mcc")) * 100
    return facts.withColumn("usd_per_point", F.when(gain > 0, F.col("spent_usd") / gain))


def refusal_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("refusals"))


def trace_completeness(traces: DataFrame, source: str = "log") -> DataFrame:
    """(source, complete): has a start, a summary, and an end or budget event. Flags combine map-side."""
    has = lambda *events: F.bool_or(F.col("event").isin(*events))
    return (traces.groupBy(source).agg(has("agent_start").alias("a"), has("search_summary").alias("b"), has(*END_EVENTS).alias("c"))
            .select(source, F.coalesce(F.col("a") & F.col("b") & F.col("c"), F.lit(False)).alias("complete")))


def search_summary(status: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row over a search: proposals and their fate, evaluations, best metrics, holdout references."""
    fate = status.agg(F.count(F.lit(1)).alias("proposals"), F.count_if(F.col("status") == "approved").alias("approved"),
                      F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    runs = evaluations.agg(F.count(F.lit(1)).alias("evaluations"), F.max("best_mcc").alias("best_mcc"), F.max("best_ap").alias("best_ap"),
                           F.count_if(F.col("improved")).alias("improved"),
                           F.coalesce(F.sum("holdout_ids_referenced"), F.lit(0)).alias("holdout_ids_referenced"))
    rate = F.coalesce(F.try_divide(F.col("approved").cast("double"), F.col("proposals")), F.lit(0.0))
    return fate.select("proposals", "approved", "quarantined", rate.alias("survival_rate"),
                       *[runs.select(c).scalar().alias(c) for c in runs.columns])


def scorecard(sections: Mapping[str, DataFrame]) -> DataFrame:
    """(section, measure, value): each one-row table becomes one row per column."""
    out = None
    for section, facts in sections.items():
        entries = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in facts.columns])
        rows = facts.select(F.lit(section).alias("section"), F.explode(entries).alias("e")).select("section", "e.measure", "e.value")
        out = rows if out is None else out.unionByName(rows)
    return out
