import json
import os

import pytest

from partflow.operators import scorecard as sc
from partflow.sources import logs as lg
from partflow.streaming import review as rv


def write(folder, name, events):
    with open(os.path.join(folder, name), "w") as handle:
        handle.write("\n".join(json.dumps(e) for e in events) + "\n")


def read(spark, folder):
    return lg.read_jsonl_log(spark, folder, lg.TRACE_SCHEMA)


def events(*items):
    return [{"at": f"2026-01-01T00:00:{i:02d}", **e} for i, e in enumerate(items)]


def turn(usd):
    return {"event": "model_turn", "spent_usd": usd}


START = {"event": "agent_start"}


def test_spend_is_the_sum_of_run_peaks(spark, folder):
    write(folder, "hypothesis-20260914T1Z.jsonl", events(START, turn(.1), turn(.3), START, turn(.05)))
    write(folder, "warden-2.jsonl", events(START, turn(.02)))
    write(folder, "refusals.jsonl", events({"event": "model_turn", "spent_usd": 9.0}))
    by_agent = sc.spend_by_agent(read(spark, folder))
    assert {r.agent: round(r.spent_usd, 4) for r in by_agent.collect()} == {"hypothesis": .35, "warden": .02}
    assert round(sc.total_spend(by_agent).first()[0], 4) == .37


def test_turns_before_the_first_start_are_a_run(spark, folder):
    write(folder, "a-1.jsonl", events(turn(.5), START, turn(.1)))
    write(folder, "b-1.jsonl", events(turn(.25), turn(.2)))
    assert {r.agent: r.spent_usd for r in sc.spend_by_agent(read(spark, folder)).collect()} == {"a": .6, "b": .25}


def test_one_agent_may_own_most_rows(spark):
    rows = [("hot-1" if i % 3 else f"cold{i % 7}-1", i, i, "agent_start" if i % 11 == 0 else "model_turn", float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "log string, block long, pos long, event string, spent_usd double").repartition(6)
    want: dict = {}
    for log in {r[0] for r in rows}:
        peak, total = 0.0, 0.0
        for r in [r for r in rows if r[0] == log]:
            if r[3] == "agent_start":
                total, peak = total + peak, 0.0
            else:
                peak = max(peak, r[4])
        want[log[:-2]] = total + peak
    assert {r.agent: r.spent_usd for r in sc.spend_by_agent(df).collect()} == want


def test_leak_lift_is_the_first_result_of_the_newest_log(spark, folder):
    result = lambda x: {"event": "tool_result", "tool": "id_shuffle_test", "result": {"lift": x, "shuffled_lift": x / 10}}
    named, other = {"event": "agent_start", "task": "Feature ('leak')"}, {"event": "agent_start", "task": "Feature ('fine')"}
    write(folder, "red-1.jsonl", events(named, result(.1)))
    write(folder, "red-2.jsonl", events(other, result(.2), named, {"event": "tool_result", "tool": "x", "result": None}, result(.3), result(.4)))
    write(folder, "red-3.jsonl", events(other, result(.5)))
    assert tuple(sc.leak_lift(read(spark, folder), "leak").first()) == ("red-2", .3, .03)
    assert sc.leak_lift(read(spark, folder), "absent").count() == 0
    write(folder, "amber-9.jsonl", events(named, result(.6)))
    assert sc.leak_lift(read(spark, folder), "leak").first().log == "amber-9"  # by stamp, not by name
    assert sc.leak_lift(read(spark, folder), "leak", agent="red").first().log == "red-2"


def test_lines_keep_their_order_over_splits_and_clocks(spark, folder):
    """Runs follow the lines of a file, though stamps are equal or go back and the file is read in many splits."""
    lines, want = [], 0.0
    for run in range(40):
        lines.append({"at": f"2026-01-01T00:00:{59 - run:02d}", **START})
        lines += [{"at": "2026-01-01T00:00:30", **turn(float(run * (i % 3)))} for i in range(20)]
        want += run * 2.0
    write(folder, "long-1.jsonl", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        traces = read(spark, folder)
        assert traces.rdd.getNumPartitions() > 10
        assert {r.agent: r.spent_usd for r in sc.spend_by_agent(traces).collect()} == {"long": want}
        assert sc.run_groups(traces).select("run").distinct().count() == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_completeness_and_dispositions(spark, folder):
    summary, end = {"event": "search_summary"}, {"event": "budget_stop"}
    write(folder, "a-1.jsonl", events(START, summary, end))
    write(folder, "b-1.jsonl", events(START, end, {"event": "disposition_outcome", "status": "rejected"}, {"event": "disposition_outcome", "status": "valid"}))
    traces = read(spark, folder)
    assert {r.log: r.complete for r in sc.trace_completeness(traces).collect()} == {"a-1": True, "b-1": False}
    assert tuple(sc.disposition_facts(traces).first()) == (2, 1)
    assert tuple(sc.disposition_facts(traces, "a").first()) == (0, 0)


def test_survival_and_spend_per_point(spark):
    status = spark.createDataFrame([("1", "a", "approved"), ("2", "b", "quarantined"), ("3", "c", "proposed")], "feature_id string, name string, status string")
    assert tuple(sc.survival(status).first()) == (1, 2, 1, .5)
    assert tuple(sc.survival(status.where("status = 'proposed'")).first()) == (0, 0, 0, 0.0)
    facts = spark.createDataFrame([(8.0, .221, .221), (8.0, .2, .22)], "spent_usd double, reference_mcc double, best_mcc double")
    assert [r.usd_per_point for r in sc.spend_per_point(facts).collect()] == [None, pytest.approx(4.0)]
    table = sc.scorecard({"search": sc.survival(status), "refusals": sc.refusal_count(status)})
    assert {(r.section, r.measure): r.value for r in table.collect()}[("refusals", "refusals")] == 3.0


def test_decisions_stream_labels_once(spark, folder):
    source = os.path.join(folder, "in")
    os.makedirs(source)
    line = {"part_id": 1, "action": "ship", "at": "2026-01-01T00:00:00"}
    write(source, "a.json", [line, line, {"part_id": 2, "action": "senior_review", "at": "2026-01-01T00:00:01"}])
    stream = rv.label_stream(rv.decision_source(spark, source))
    out, state = os.path.join(folder, "out"), os.path.join(folder, "state")
    rv.append_to(stream, out, state).awaitTermination()
    write(source, "b.json", [line, {"part_id": 3, "action": "scrap", "at": "2026-01-01T00:00:02"}])
    rv.append_to(rv.label_stream(rv.decision_source(spark, source)), out, state).awaitTermination()
    late = [{**line, "at": "2020-01-01T00:00:00"}, {**line, "action": "scrap"}]
    write(source, "c.json", late)
    rv.append_to(rv.label_stream(rv.decision_source(spark, source)), out, state).awaitTermination()
    written = spark.read.parquet(out)  # the stream itself drops repeats, across restarts
    assert written.count() == rv.each_once(written).count() == 5
    assert written.where("part_id = 1").count() == 3  # the late one and the second action of the same second stay
    rows = written.where("year(at) = 2026 AND NOT (part_id = 1 AND action = 'scrap')").collect()
    assert sorted((r.part_id, r.action, r.label) for r in rows if r.label is not None) == [(1, "ship", 0), (3, "scrap", 1)] and len(rows) == 3


def test_equal_decisions_of_one_second_are_told_apart_by_number(spark, folder):
    source = os.path.join(folder, "in")
    os.makedirs(source)
    line = {"part_id": 1, "action": "ship", "at": "2026-01-01 00:00:00"}
    write(source, "a.json", [{**line, "decision_id": 1}, {**line, "decision_id": 2}])
    write(source, "b.json", [{**line, "decision_id": 2}])
    assert rv.each_once(rv.drain(rv.label_stream(rv.decision_source(spark, source)), "labels")).count() == 2


def test_damaged_lines_and_unknown_fields_stay(spark, folder):
    good = [json.dumps({"at": "2026-01-01", "event": "agent_start", "task": "t", "model": {"name": "m", "size": 3}}), json.dumps({"event": 7})]
    with open(os.path.join(folder, "a-1.jsonl"), "w") as f:
        f.write("\n".join([good[0], '{"event": "cut', "", good[1], "[1]", '"text"', "null"]) + "\n")
    log = read(spark, folder)
    rows = lg.sound(log).select("event", "task", lg.field("$.model.name", "string").alias("name"), lg.field("$.model.size", "int").alias("size"), lg.field("$.nothing", "int").alias("none")).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted([("agent_start", "t", "m", 3, None), ("7", None, None, None, None)], key=repr)
    lost = lg.damaged(log).orderBy("block", "pos").collect()
    assert [r.damaged for r in lost] == ['{"event": "cut', "[1]", '"text"', "null"] and {r.log for r in lost} == {"a-1"}
    places = [r.pos for r in log.orderBy("block", "pos").collect()]
    assert len(places) == 6 and places == sorted(set(places))


def test_parts_stream_is_routed(spark, folder):
    source = os.path.join(folder, "scores")
    spark.createDataFrame([(1, .05), (2, .1), (3, .39), (4, .4)], "id long, p double").write.parquet(source)
    stream = spark.readStream.schema("id long, p double").parquet(source)
    assert {r.id: r.decision for r in rv.drain(rv.route_stream(stream, .1, .4), "t").collect()} == {1: "ship", 2: "review", 3: "review", 4: "inspect"}
