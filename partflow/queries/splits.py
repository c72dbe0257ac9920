"""Splits, split views, seeded subsets, global ranks and set checks over all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.functions.scoring import seeded_below
from partflow.operators import ranking, splits as sp
from partflow.operators.sandbox import bind_ids, id_map, zip_by_rank
from partflow.plans.ensemble import early_stopping_tail
from partflow.plans.leaks import id_gap
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.queries.sqlparts import hash_sql
from partflow.session import scratch_path
from partflow.sources.tables import split_fingerprint, write_splits


def starts(spark, folder):
    return sp.start_times(b.dates(spark, folder))


def fingerprints(spark, folder):
    assigned = b.split_table(spark, folder)
    one, two, three = (split_fingerprint(assigned, name) for name in sp.SPLITS)
    return one.unionByName(two).unionByName(three)


def s14(spark, folder):
    path = scratch_path(spark, "splits")
    write_splits(b.splits(spark, folder), path)
    return spark.read.parquet(path)


def j5(spark, folder):
    """Every order beside the order of the same rank by price."""
    orders = b.table(spark, folder, "orders")
    left = orders.select(F.col("o_orderkey").alias("Id"))
    right = orders.select(F.col("o_orderkey").alias("by_price"), "o_totalprice")
    return zip_by_rank(left, right, ["Id"], ["o_totalprice", "by_price"]).select("Id", "by_price")


def w2(spark, folder):
    ids = b.parts(spark, folder).select("Id")
    keyed = ids.withColumn("k", F.expr("pmod(Id * 7919, 1009)"))
    return ranking.row_numbers(keyed, ["k", "Id"], "rn").select("Id", "rn")


def w5(spark, folder):
    return early_stopping_tail(starts(spark, folder).withColumnRenamed("min_ts", "start_ts"), 0.15)


def w6(spark, folder):
    """Running amount over all line items by day, an ordering with many ties broken by the row's keys."""
    daily = (b.table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), "l_suppkey")
             .agg(F.count(F.lit(1)).alias("n")))
    return ranking.running_totals(daily, ["day", "l_suppkey"], {"running": "n"}, row_number="rn").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "l_suppkey", "n", "running", "rn")


def quantiles_by(spark, folder):
    items = b.table(spark, folder, "lineitem")
    return ranking.exact_quantiles(items, "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, by=["l_returnflag"])


def t2(spark, folder):
    assigned = b.split_table(spark, folder)
    exposed = assigned.where(F.col("split") != "holdout")
    return sp.disjoint(exposed, sp.in_split(assigned, "holdout"))


def j12(spark, folder):
    """Orders with a first reading late in the data, audited against the holdout."""
    late = b.split_table(spark, folder).where(F.col("min_ts") > 2000)
    return sp.holdout_audit(late, b.split_table(spark, folder))


def t1(spark, folder):
    assigned = b.split_table(spark, folder)
    evaluated = b.scores(spark, folder).where("p >= 0.5").select(F.col("id").alias("Id"))
    return sp.intersect_ids(evaluated, sp.in_split(assigned, "holdout"))


SHUFFLED = ("m AS (SELECT a.Id, s.bound_id FROM (SELECT Id, row_number() OVER (ORDER BY Id) AS r FROM ids) a JOIN "
            f"(SELECT Id AS bound_id, row_number() OVER (ORDER BY {hash_sql('Id', '17')}, Id) AS r FROM ids) s USING (r))")
IDS = "ids AS (SELECT Id FROM splits WHERE split = 'train')"
SUBSET = f"{hash_sql('Id', '17')} % 1000 < 500"

QUERIES = [
    Query("A1_time_cuts", lambda s, d: sp.time_cuts(starts(s, d)), b.with_ctes("cuts", "SELECT * FROM cuts")),
    Query("A1_exact_quantiles_by_group", quantiles_by,
          "SELECT l_returnflag, " + ", ".join(f"quantile_disc(l_extendedprice, CAST({q} AS DOUBLE)) AS {n}" for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99)))
          + " FROM lineitem GROUP BY l_returnflag"),
    Query("A2_assign_splits", lambda s, d: b.splits(s, d), b.with_ctes("splits", "SELECT * FROM splits")),
    Query("A3_split_report", lambda s, d: sp.split_report(b.splits(s, d)),
          b.with_ctes("splits", "SELECT n.split, count(s.Id) AS parts, count(s.Id) FILTER (s.min_ts IS NULL) AS undated, "
                                "CASE WHEN count(s.Id) = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM (VALUES ('train'), ('validation'), ('holdout')) n(split) "
                                "LEFT JOIN splits s ON s.split = n.split GROUP BY n.split")),
    Query("F1_in_split", lambda s, d: sp.in_split(b.split_table(s, d), "validation"), b.with_ctes("splits", "SELECT * FROM splits WHERE split = 'validation'")),
    Query("F5_point_lookup", lambda s, d: b.table(s, d, "orders").transform(lambda o: sp.point_lookup(o.withColumnRenamed("o_orderkey", "Id"), 77)).select("Id", "o_custkey", "o_totalprice"),
          "SELECT o_orderkey AS Id, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77"),
    Query("F6_seeded_subset", lambda s, d: b.parts(s, d).where(seeded_below(F.col("Id"), 17, 0.5)).select("Id"),
          b.with_ctes("parts", f"SELECT Id FROM parts WHERE {SUBSET}")),
    Query("F7_seeded_holdback", lambda s, d: b.parts(s, d).withColumn("fit", seeded_below(F.col("Id"), 18, 0.8)).select("Id", "fit"),
          b.with_ctes("parts", f"SELECT Id, {hash_sql('Id', '18')} % 1000 < 800 AS fit FROM parts")),
    Query("J1_split_view", lambda s, d: sp.split_view(b.numeric(s, d), b.split_table(s, d), "validation"),
          b.with_ctes("num splits", "SELECT * FROM num WHERE Id IN (SELECT Id FROM splits WHERE split = 'validation')")),
    Query("J4_bind_ids", lambda s, d: bind_ids(sp.split_view(b.numeric(s, d), b.split_table(s, d), "train"), id_map(sp.in_split(b.split_table(s, d), "train"), "shuffled")),
          b.with_ctes("num splits", "SELECT m.bound_id AS Id, num.* EXCLUDE (Id, Response) FROM num JOIN m USING (Id)", f"{IDS}, {SHUFFLED}")),
    Query("J5_zip_by_rank", j5,
          "SELECT a.Id, p.by_price FROM (SELECT o_orderkey AS Id, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) a JOIN "
          "(SELECT o_orderkey AS by_price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) p USING (r)"),
    Query("J12_holdout_audit", j12,
          b.with_ctes("splits", "SELECT count(*) AS holdout_ids_referenced FROM splits WHERE min_ts > 2000 AND split = 'holdout'")),
    Query("L1_id_map_shuffled", lambda s, d: id_map(sp.in_split(b.split_table(s, d), "train"), "shuffled"), b.with_ctes("splits", "SELECT Id, bound_id FROM m", f"{IDS}, {SHUFFLED}")),
    Query("L1_id_map_subset", lambda s, d: id_map(sp.in_split(b.split_table(s, d), "train"), "subset"), b.with_ctes("splits", f"SELECT Id, Id AS bound_id FROM ids WHERE {SUBSET}", IDS)),
    Query("O1_by_id", lambda s, d: sp.by_id(b.parts(s, d)), b.with_ctes("parts", "SELECT * FROM parts ORDER BY Id")),
    Query("O2_by_split", lambda s, d: sp.by_split(b.split_table(s, d).select("Id", "split")), b.with_ctes("splits", "SELECT Id, split FROM splits ORDER BY split, Id")),
    Query("O6_first_rows", lambda s, d: sp.first_rows(sp.by_id(b.parts(s, d)), 100), b.with_ctes("parts", "SELECT * FROM parts ORDER BY Id LIMIT 100")),
    Query("S13_split_fingerprint", fingerprints,
          b.with_ctes("splits", "SELECT split, rows, xor_hash, sum_hash, sha256(rows || '|' || xor_hash || '|' || sum_hash) AS digest FROM ("
                                "SELECT split, count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h % 2147483648) AS BIGINT) AS sum_hash FROM ("
                                f"SELECT split, {hash_sql('Id')} AS h FROM splits) GROUP BY split)")),
    Query("S14_write_splits", s14, b.with_ctes("splits", "SELECT Id, split FROM splits")),
    Query("T1_intersect_ids", t1, b.with_ctes("scores splits", "SELECT c.id AS Id FROM scores c JOIN splits s ON s.Id = c.id WHERE p >= 0.5 AND split = 'holdout'")),
    Query("T2_disjoint", t2, b.with_ctes("splits", "SELECT CAST(0 AS BIGINT) AS overlap, count(*) > 0 AS disjoint FROM splits")),
    Query("W2_dist_row_number", w2, b.with_ctes("parts", "SELECT Id, row_number() OVER (ORDER BY (Id * 7919) % 1009, Id) AS rn FROM parts")),
    Query("W3_id_gap_prev", lambda s, d: id_gap(b.dates(s, d), "prev"),
          b.with_ctes("starts", "SELECT Id, Id - lag(Id) OVER (ORDER BY min_ts NULLS LAST, Id) AS id_gap FROM starts")),
    Query("W3_id_gap_next", lambda s, d: id_gap(b.dates(s, d), "next"),
          b.with_ctes("starts", "SELECT Id, lead(Id) OVER (ORDER BY min_ts NULLS LAST, Id) - Id AS id_gap FROM starts")),
    Query("W5_early_stopping_tail", w5,
          b.with_ctes("starts", "SELECT Id, coalesce(r <= n, false) AS in_tail FROM starts LEFT JOIN (SELECT Id, row_number() OVER (ORDER BY min_ts DESC, Id DESC) AS r "
                                "FROM starts WHERE min_ts IS NOT NULL) q USING (Id), (SELECT CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS n FROM starts) t")),
    Query("W6_running_totals", w6,
          "SELECT strftime(day, '%Y-%m-%d') AS day, l_suppkey, n, CAST(sum(n) OVER (ORDER BY day, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, "
          "row_number() OVER (ORDER BY day, l_suppkey) AS rn FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)"),
]
