"""The acceptance rule of a feature search, folded over its evaluation log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AcceptConfig:
    """Fixed values of the published search rule."""

    min_delta_mcc: float = 0.004
    noise_multiplier: float = 2.0
    stop_after: int = 3
    max_evaluations: int = 40


def accept(evaluations: DataFrame, reference: DataFrame, config: AcceptConfig = AcceptConfig()) -> DataFrame:
    """Per evaluation (search, seq): the bars it faced, whether it improved, and the best so far.

    evaluations(search, seq, mcc, ap), reference(search, mcc, ap, sd_mcc, sd_ap). A result counts when MCC clears
    best + max(min_delta, k * sd) and AP clears best + k * sd. A search ends after `stop_after` failures in a row
    or `max_evaluations` calls; that call budget is the rule's own, so at most that many rows of a search are ever
    folded, and the fold is an aggregate over a short array.
    """
    order = Window.partitionBy("search").orderBy("seq")
    called = evaluations.withColumn("call", F.row_number().over(order)).where(F.col("call") <= config.max_evaluations)
    logs = called.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("call", "seq", "mcc", "ap"))).alias("calls"))
    start = reference.select("search", F.col("mcc").alias("mcc0"), F.col("ap").alias("ap0"), "sd_mcc", "sd_ap")
    k, delta = config.noise_multiplier, config.min_delta_mcc
    fold = f"""aggregate(calls,
      named_struct('best_mcc', mcc0, 'best_ap', ap0, 'fails', 0,
                   'out', cast(array() as array<struct<call:int,mcc_bar:double,ap_bar:double,improved:boolean,
                               best_mcc:double,best_ap:double,consecutive_failures:int>>)),
      (s, e) -> if(s.fails >= {config.stop_after}, s,
        transform(array(named_struct(
            'mb', s.best_mcc + greatest({delta}D, {k}D * sd_mcc), 'ab', s.best_ap + {k}D * sd_ap)),
          b -> named_struct(
            'best_mcc', if(e.mcc >= b.mb and e.ap >= b.ab, e.mcc, s.best_mcc),
            'best_ap', if(e.mcc >= b.mb and e.ap >= b.ab, e.ap, s.best_ap),
            'fails', if(e.mcc >= b.mb and e.ap >= b.ab, 0, s.fails + 1),
            'out', concat(s.out, array(named_struct('call', e.call, 'mcc_bar', b.mb, 'ap_bar', b.ab,
                     'improved', e.mcc >= b.mb and e.ap >= b.ab,
                     'best_mcc', if(e.mcc >= b.mb and e.ap >= b.ab, e.mcc, s.best_mcc),
                     'best_ap', if(e.mcc >= b.mb and e.ap >= b.ab, e.ap, s.best_ap),
                     'consecutive_failures', if(e.mcc >= b.mb and e.ap >= b.ab, 0, s.fails + 1))))))[0]),
      s -> s.out)"""
    folded = logs.join(start, "search").select("search", F.explode(F.expr(fold)).alias("o")).select("search", "o.*")
    out = folded.join(called.select("search", "call", "seq", "mcc", "ap"), ["search", "call"])
    stop = (F.when(F.col("consecutive_failures") >= config.stop_after, "consecutive failures")
            .when(F.col("call") >= config.max_evaluations, "evaluation budget"))
    return out.withColumn("stop_reason", stop)


def accept_all(evaluations: DataFrame, reference: DataFrame, config: AcceptConfig = AcceptConfig()) -> DataFrame:
    """Every evaluation with the fold's columns; counted is false, and those are null, after its search has ended."""
    rows = accept(evaluations, reference, config).drop("mcc", "ap").withColumn("counted", F.lit(True))
    return evaluations.select("search", "seq", "mcc", "ap").join(rows, ["search", "seq"], "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
