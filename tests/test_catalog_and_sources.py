import gzip
import hashlib
import os
import random

import pytest

from partflow.functions.columns import category_code
from partflow.sources import catalog as cat, logs as lg, measurements as ms, tables as tb


def test_names_follow_the_rule():
    assert cat.parse("L3_S38_F3956", "numeric").station_name == "L3_S38"
    for name, kind in (("L0_S0_D1", "numeric"), ("L0_S0_F0", "date"), ("row_index", "numeric")):
        with pytest.raises(cat.ContractError):
            cat.parse(name, kind)


def test_schema_types_come_from_names():
    schema = cat.table_schema(["Id", "Response", "L0_S1_F25"], "numeric")
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "tinyint", "double"]
    assert cat.table_schema(["Id", "L0_S1_F25", "L0_S1_F27"], "categorical")[1].dataType.simpleString() == "string"


def test_column_difference_goes_by_name_and_then_by_order(spark):
    table = lambda *names: spark.createDataFrame([("numeric", n, i) for i, n in enumerate(names)], "kind string, name string, position int")
    found = lambda a, b: sorted((r.name, r.side) for r in cat.column_difference(a, b).collect())
    assert found(table("a", "b", "c"), table("b", "c")) == [("a", "left")]
    assert found(table("a", "b"), table("a", "x", "b")) == [("x", "right")]
    assert found(table("a", "b", "c"), table("a", "c", "b")) == [("b", "order"), ("c", "order")]


def test_codes_of_nineteen_digits(spark):
    rows = spark.createDataFrame([("T1234567890123456789",), ("T9999999999999999999",), ("T-7",)], "c string")
    assert [r[0] for r in rows.select(category_code("c")).collect()] == [1234567890123456789, None, -7]


@pytest.mark.parametrize("ending", ["", "\n"])
def test_csv_is_typed_and_reconciles(spark, folder, ending):
    csv, parquet = os.path.join(folder, "in.csv"), os.path.join(folder, "out.parquet")
    with open(csv, "w") as handle:
        handle.write("Id,L0_S1_F25,L0_S1_F27\n4,,T1\n6,T2,\n7,T48576,T9" + ending)
    df = ms.read_measurements(spark, csv, "categorical")
    assert df.dtypes == [("Id", "bigint"), ("L0_S1_F25", "string"), ("L0_S1_F27", "string")]
    assert [tuple(r) for r in df.orderBy("Id").collect()] == [(4, None, "T1"), (6, "T2", None), (7, "T48576", "T9")]
    ms.write_measurements(df, parquet, "categorical")
    assert tuple(ms.reconcile_rows(spark, csv, parquet).first()) == (3, 3, True)


def test_bad_value_and_bad_column_fail(spark, folder):
    csv = os.path.join(folder, "bad.csv")
    with open(csv, "w") as handle:
        handle.write("Id,L0_S1_F25\n1,abc\n")
    with pytest.raises(Exception):
        ms.read_measurements(spark, csv, "numeric").collect()
    with pytest.raises(cat.ContractError):
        ms.read_measurements(spark, csv, "date")


def test_audit_verdicts_match_hashlib(spark, folder):
    for name, text in (("a.csv", "1"), ("b.csv", "2"), ("c.csv", "3")):
        with open(os.path.join(folder, name), "w") as handle:
            handle.write(text)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    manifest = spark.createDataFrame([("a.csv", digest("1")), ("b.csv", digest("x")), ("gone.csv", digest("y"))], ms.MANIFEST_SCHEMA)
    found = {r.name: r.verdict for r in ms.audit_files(ms.file_digests(spark, folder, "*.csv"), manifest).collect()}
    assert found == {"a.csv": "ok", "b.csv": "mismatch", "c.csv": "unlisted", "gone.csv": "missing"}


def test_a_large_file_is_hashed_as_a_stream(spark, folder, monkeypatch):
    """Files above the limit never become one row; what their blocks give makes their bytes again."""
    rng, texts = random.Random(2), {"end.csv": b"a\nb\n", "open.csv": b"a\n\nb", "crlf.csv": b"\r\n\r\n\n", "feeds.csv": b"\n" * 5000, "one +1.csv": b"x" * 3000}
    texts |= {f"r{i}.csv": rng.randbytes(20_000 + i) + b"\n" * (i % 3) for i in range(5)} | {"tiny.csv": b"1", "a b.csv.gz": gzip.compress(b"y" * 100)}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "wb") as handle:
            handle.write(text)
    monkeypatch.setattr(ms, "WHOLE_BYTES", 3, raising=False)
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = ms.file_digests(spark, folder, "*.csv*")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.name: (r.bytes, r.sha256) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    assert "LessThanOrEqual(length,3)" in plan  # no content of a larger file is asked for
    assert got == {name: (len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items()}


def test_a_table_of_several_files_goes_by_its_own_name(spark, folder):
    spark.range(5).coalesce(1).write.parquet(os.path.join(folder, "few.parquet"))
    spark.range(50).repartition(3).write.parquet(os.path.join(folder, "many.parquet"))
    with open(os.path.join(folder, "one.parquet"), "wb") as handle:
        handle.write(b"1")
    found = {r.name: r.sha256 for r in ms.table_digests(spark, folder).collect()}
    assert set(found) == {"few.parquet", "many.parquet", "one.parquet"} and found["one.parquet"] == hashlib.sha256(b"1").hexdigest()
    spark.range(1).write.mode("append").parquet(os.path.join(folder, "few.parquet"))
    again = {r.name: r.sha256 for r in ms.table_digests(spark, folder).collect()}
    assert [n for n in found if found[n] != again[n]] == ["few.parquet"]


def test_stale_inputs(spark):
    inventory = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "name string, sha256 string")
    log = spark.createDataFrame([("a", "1", 5), ("b", "old", 5), ("c", "3", 5)], "name string, sha256 string, rows long")
    converted = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4)], "name string, rows long")
    assert {r.name for r in ms.stale_inputs(inventory, log, converted).collect()} == {"b", "c", "d"}


def test_station_map_is_in_numeric_order(spark):
    df = spark.createDataFrame([], "Id long, L0_S10_F1 double, L0_S2_F5 double, L0_S2_F12 double, L10_S1_F3 double, L2_S3_F4 double")
    rows = cat.station_map(cat.column_catalog(df, "numeric")).collect()
    assert [(r.line, r.station, r.columns) for r in rows] == [
        (0, 2, ["L0_S2_F5", "L0_S2_F12"]), (0, 10, ["L0_S10_F1"]), (2, 3, ["L2_S3_F4"]), (10, 1, ["L10_S1_F3"])]


def test_contract_reports_each_violation(spark, tables):
    expected = {"numeric": 3, "date": 3, "categorical": 2}
    assert cat.check_contract(tables, tables, expected, 4).count() == 0
    test = {**tables, "numeric": tables["numeric"].select("Id", "L0_S0_F2", "L0_S0_F0", "L1_S24_F1")}
    train = {**tables, "numeric": tables["numeric"].drop("Response"), "date": tables["date"].where("Id < 4")}
    rules = {(r.kind, r.rule) for r in cat.check_contract(train, test, {**expected, "categorical": 9}, 4).collect()}
    assert rules == {("numeric", "test_columns"), ("numeric", "label"), ("categorical", "column_count"), ("date", "row_count")}
    with pytest.raises(cat.ContractError):
        cat.require_contract(cat.check_contract(train, test, expected, 4))


def test_fingerprint_ignores_order_and_partitioning(spark):
    ids = spark.range(1000).withColumnRenamed("id", "Id")
    base = tb.fingerprint(ids, ["Id"]).first()
    assert tb.fingerprint(ids.orderBy(ids.Id.desc()).repartition(7), ["Id"]).first() == base
    assert tb.fingerprint(ids.where("Id <> 500"), ["Id"]).first().digest != base.digest


def test_labels_append_and_filter(spark, folder):
    path = os.path.join(folder, "labels")
    for action in ("ship", "scrap", "senior_review"):
        lg.append_label(spark.createDataFrame([(7, action, "2026-01-01T00:00:00")], "part_id long, action string, at string"), path)
    rows = lg.read_jsonl_log(spark, path, lg.DECISION_SCHEMA)
    assert {(r.action, r.label) for r in rows.collect()} == {("ship", 0), ("scrap", 1), ("senior_review", None)}
    assert lg.labelled_only(rows).count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tables, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind in ("numeric", "date"):
            ms.write_bucketed(tables[kind], f"bucketed_{kind}", os.path.join(folder, kind), 4)
        joined = spark.table("bucketed_numeric").join(spark.table("bucketed_date"), "Id")
        assert joined.count() == 4
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for kind in ("numeric", "date"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{kind}")


def test_split_folders_are_pruned(spark, tables, folder):
    splits = spark.createDataFrame([(1, "train"), (2, "train"), (3, "validation"), (4, "holdout")], "Id long, split string")
    path = os.path.join(folder, "by_split")
    ms.write_by_split(tables["date"], splits, path)
    train = ms.read_split(spark, path, "train")
    assert sorted(train.collect()) == sorted(tables["date"].where("Id <= 2").collect())
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "Join" not in plan
