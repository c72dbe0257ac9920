"""Check written dispositions against the evidence they cite, for all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partflow.functions.scoring import close_to

# The shape of a column token, the allowed recommendations, the text fields, the required fields.
COLUMN_TOKEN = r"\bL[0-9]+_S[0-9]+_[FD][0-9]+\b"
RECOMMENDATIONS = ("scrap", "ship", "senior_review")
TEXT_FIELDS = ("route", "reason", "neighbor_summary")
REQUIRED = ("route", "recommendation", "reason", "out_of_range", "neighbor_summary", "citations")

DISPOSITION_SCHEMA = (
    "part_id long, disposition struct<route: string, recommendation: string, reason: string, "
    "out_of_range: array<struct<column: string, value: double, low: double, high: double>>, "
    "neighbor_summary: string, citations: array<struct<kind: string, value: string>>>, "
    "allowed_columns array<string>, allowed_part_ids array<long>")


def _tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COLUMN_TOKEN), F.lit(0))))


def _column_claims(where: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(where).alias("where"), n.alias("column")))


def claims(dispositions: DataFrame) -> DataFrame:
    """Every column a disposition mentions: (part_id, where, column), from citations and from free text."""
    cited = F.transform(F.filter("disposition.citations", lambda c: c["kind"] == "column"), lambda c: c["value"])
    text = [_column_claims(f, _tokens(F.col(f"disposition.{f}"))) for f in TEXT_FIELDS]
    return (dispositions.select("part_id", F.explode(F.concat(_column_claims("citation", cited), *text)).alias("c"))
            .select("part_id", "c.where", "c.column"))


def unknown_columns(dispositions: DataFrame, schema_columns: DataFrame) -> DataFrame:
    """Claims about columns that do not exist. schema_columns has one row per column of the tables."""
    names = F.broadcast(schema_columns.select(F.col("name").alias("column")))
    return claims(dispositions).join(names, "column", "left_anti")


def validate_dispositions(queue: DataFrame, dispositions: DataFrame, evidence: DataFrame,
                          schema_columns: DataFrame) -> DataFrame:
    """(part_id, status, recommendation, errors) for every queued part.

    status is valid, rejected or missing; anything but valid recommends senior_review. Each disposition meets its
    own evidence record in one join on part_id, and all checks are array expressions on that row. Names are looked up among
    the schema's columns by one join of all claims, so no claim is compared with every column.
    """
    unknown = unknown_columns(dispositions, schema_columns).groupBy("part_id").agg(F.collect_set("column").alias("unknown"))
    d = F.col("disposition")
    rows = (queue.select("part_id").join(dispositions, "part_id", "left")
            .join(evidence.select("part_id", F.col("out_of_range").alias("actual")), "part_id", "left")
            .join(unknown, "part_id", "left"))

    none = F.array().cast("array<string>")
    missing = F.filter(F.array(*[F.when(F.col(f"disposition.{f}").isNull(), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull())
    missing_errors = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("left out: "), F.array_join(missing, ", ")))).otherwise(none)

    bad_choice = F.when(~d["recommendation"].isin(*RECOMMENDATIONS),
                        F.array(F.concat(F.lit("recommendation "), d["recommendation"], F.lit(" is none of the choices")))).otherwise(none)

    def column_error(where: str, name: Column) -> Column:
        absent = F.array_contains(F.coalesce(F.col("unknown"), none), name) | (name == "")
        return (F.when(absent, F.concat(F.lit(f"{where}: column "), name, F.lit(" names no column of the tables")))
                .when(~F.array_contains(F.coalesce(F.col("allowed_columns"), none), name),
                      F.concat(F.lit(f"{where}: column "), name, F.lit(" is missing from the part record"))))

    digits = r"^[0-9]{1,19}$"  # what does not fit 64 bits was not returned

    def citation_error(c: Column) -> Column:
        returned = F.coalesce(c["value"].rlike(digits)
                              & F.array_contains("allowed_part_ids", F.when(c["value"].rlike(digits), c["value"]).try_cast("bigint")),
                              F.lit(False))
        return (F.when(c["kind"] == "column", column_error("citation", F.coalesce(c["value"], F.lit(""))))
                .when(c["kind"] == "part", F.when(~returned, F.concat(F.lit("citation: part "), F.coalesce(c["value"], F.lit("")),
                                                                       F.lit(" came from no tool result"))))
                .otherwise(F.concat(F.lit("citation: no such kind "), F.coalesce(c["kind"], F.lit("null")))))

    def range_error(e: Column) -> Column:
        truth = F.try_element_at(F.filter("actual", lambda a: a["name"] == e["column"]), F.lit(1))
        agrees = F.coalesce(close_to(e["value"], truth["value"]) & close_to(e["low"], truth["low"]) & close_to(e["high"], truth["high"]), F.lit(False))
        name = F.coalesce(e["column"], F.lit("null"))
        return (F.when(truth.isNull(), F.concat(F.lit("out_of_range: "), name, F.lit(" lies within its range here")))
                .when(~agrees, F.concat(F.lit("out_of_range: "), name, F.lit(" is quoted with other values"))))

    def found(errors: Column) -> Column:
        return F.coalesce(F.filter(errors, lambda x: x.isNotNull()), none)

    def text_error(field: str) -> Column:
        return found(F.transform(_tokens(d[field]), lambda token: column_error(field, token)))

    text_errors = [text_error(f) for f in TEXT_FIELDS]
    checks = F.concat(F.coalesce(bad_choice, none), found(F.transform(d["citations"], citation_error)),
                      found(F.transform(d["out_of_range"], range_error)), *text_errors)
    errors = F.when(d.isNull(), none).when(F.size(missing) > 0, missing_errors).otherwise(checks)
    judged = rows.select("part_id", d["recommendation"].alias("proposed"), d.isNull().alias("absent"), errors.alias("errors"))
    status = F.when(F.col("absent"), "missing").when(F.size("errors") > 0, "rejected").otherwise("valid")
    return judged.select("part_id", status.alias("status"),
                         F.when(status == "valid", F.col("proposed")).otherwise("senior_review").alias("recommendation"), "errors")
