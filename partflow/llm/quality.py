"""Quality rules with thresholds read off mergeable quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SPACES, SYMBOLS, RUN = r"[\x20\x09-\x0D]+", "#*$%&|<>", 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # base rules: words at least, repeated words in percent at most
PRIOR, UNIT = 50, 1_000_000  # documents that the language's sketch counts for beside a group's own, and the corpus's beside a language's
# Rates that are judged: numerator and denominator (both columns), in thousandths. One symbol or one repeated line is not yet a
# rate: the first of the numerator is left out.
RATES = (("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("word_chars", "n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source of each row with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, base_failed.
    A null or empty text has no word and fails the base rules. Other columns of docs are not carried on."""
    docs = docs.select("doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("__words", F.array_remove(F.split(text, SPACES, -1), ""))
    out = out.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("__words").cast("long"))
    h = F.col("__hashes")
    runs = F.transform(F.sequence(F.lit(1), F.size(h) - RUN + 1), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(RUN)]))
    out = out.withColumn("__runs", F.when(F.size(h) >= RUN, runs).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("__runs")) < F.size("__runs")
    sorted_runs = F.array_sort(F.transform("__runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(twice, sorted_runs))
    s = F.col("__sorted")
    same = lambda x, at: F.when((at < 0) | (at >= F.size(s)), False).otherwise(F.element_at(s, at + 1)["x"] == x)
    places = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x["x"], i - 1) | same(x["x"], i + 1)), lambda x: x["i"]))
    out = out.withColumn("__places", places)
    p = F.col("__places")
    covered = F.transform(p, lambda at, i: F.when(i + 1 >= F.size(p), RUN).otherwise(F.least(F.lit(RUN), F.element_at(p, i + 2) - at)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("word_chars", F.length(F.translate(text, WHITE, "")).cast("long")).withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__words", "__hashes", "__runs", "__sorted", "__places", "__lines", "text")


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number: itself below 64, above that 32 buckets for each doubling, a relative error of
    3 %. Counts of buckets add up, so sketches merge, and the result does not depend on the order."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function("shiftright", value, shift))


def upper_end(at: Column) -> Column:
    """The largest number in a bucket."""
    return F.when(at < 64, at).otherwise(F.call_function("shiftleft", F.pmod(at, F.lit(32)) + 33, (F.floor(at / 32) - 1).cast("int")) - 1)


def rate_of(top: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.expr(f"1000 * greatest({top} - 1, 0L) DIV {under}")).otherwise(F.lit(0)).cast("long")


def _key(name: str) -> Column:
    """A column's value as a text that is never null, so that null groups join like others."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def thresholds(measures: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, upper): the bound of each rate for each language and source.

    Every group has its own sketch at every size. To its counts come PRIOR documents spread as in its language, whose own
    counts have PRIOR documents of the corpus beside them; so a small group leans on its language, a large one on itself, and
    no size changes the rule. Of the joint sketch the bound is the 90th percentile, plus three times its distance from the
    median, plus a quarter of the distance from the median to the 98th percentile. Counts are whole numbers of UNIT parts, so
    no order of additions changes a bound. Documents that fail the base rules are not counted.
    """
    rates = F.array(*[F.struct(F.lit(top).alias("rate"), rate_of(top, under).alias("value")) for top, under in RATES])
    rows = measures.filter("NOT base_failed").select(_key("lang").alias("lang_key"), _key("source").alias("source_key"), F.explode(rates).alias("r")).select("lang_key", "source_key", "r.*")
    own = rows.groupBy("lang_key", "source_key", "rate", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = own.groupBy("lang_key", "rate", "bucket").agg(F.sum("n").alias("n"))
    everywhere = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    whole = everywhere.groupBy("rate").agg(F.sum("n").alias("total"))
    shares = everywhere.join(whole, "rate").select("rate", "bucket", F.expr(f"{UNIT} * n DIV total").alias("share"))
    langs = by_lang.groupBy("lang_key", "rate").agg(F.sum("n").alias("total")).join(shares, "rate")
    langs = langs.join(by_lang, ["lang_key", "rate", "bucket"], "left").select("lang_key", "rate", "bucket", F.expr(f"({UNIT} * coalesce(n, 0L) + {PRIOR} * share) DIV (total + {PRIOR})").alias("share"))
    groups = own.select("lang_key", "source_key", "rate").distinct().join(langs, ["lang_key", "rate"])
    joint = groups.join(own, ["lang_key", "source_key", "rate", "bucket"], "left").withColumn("weight", F.expr(f"{UNIT} * coalesce(n, 0L) + {PRIOR} * share"))
    keys = ["lang_key", "source_key", "rate"]  # a group has as many rows as the sketch has buckets
    read = joint.withColumn("below", F.sum("weight").over(Window.partitionBy(*keys).orderBy("bucket"))).withColumn("total", F.sum("weight").over(Window.partitionBy(*keys)))
    at = lambda percent: F.min(F.when(100 * F.col("below") >= percent * F.col("total"), upper_end(F.col("bucket"))))
    found = read.groupBy(*keys).agg(at(50).alias("middle"), at(90).alias("high"), at(98).alias("tail"))
    return found.select(*keys, F.expr("high + 3 * (high - middle) + (tail - middle) DIV 4").alias("upper"))


def judge(measures: DataFrame) -> DataFrame:
    """The measures with kept: the base rules hold and no rate is above its group's bound.

    Null languages and sources are groups like others. A group none of whose documents passes the base rules has no bounds
    and keeps none. An empty table gives no rows; repeated rows count each time.
    """
    bounds = thresholds(measures).groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("rate") == top, F.col("upper"))).alias(f"__{top}") for top, _ in RATES])
    bounds = bounds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = measures.withColumns({"lang_key": _key("lang"), "source_key": _key("source"), "__salt": F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(16)).cast("int")})
    joined = rows.join(bounds, ["lang_key", "source_key", "__salt"], "left")
    fine = ~F.col("base_failed")
    for top, under in RATES:
        fine = fine & F.coalesce(rate_of(top, under) <= F.col(f"__{top}"), F.lit(False))
    return joined.withColumn("kept", fine).drop("lang_key", "source_key", "__salt", *[f"__{top}" for top, _ in RATES])


def quality_sql() -> str:
    symbols = "".join("\\" + c if c in "$*|" else c for c in SYMBOLS)
    number = lambda c: f"CASE WHEN {c} < 64 THEN {c} ELSE (length(bin({c})) - 6) * 32 + ({c} >> (length(bin({c})) - 6)) END"
    rates = " UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{top}' AS rate, CASE WHEN {under} > 0 THEN 1000 * greatest({top} - 1, 0) // {under} ELSE 0 END AS value FROM m" for top, under in RATES)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    runs AS (SELECT r, i, array_to_string(list_slice(words, i, i + {RUN - 1}), ' ') AS run FROM (SELECT r, words, unnest(range(1, len(words) - {RUN - 2})) AS i FROM w)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, {RUN}) AS o(j) GROUP BY r),
    m AS (SELECT w.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[{symbols}]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(words) < {LEAST_WORDS} OR 100 * coalesce(covered.n, 0) > {MOST_REPEATED} * len(words) AS base_failed FROM w LEFT JOIN covered USING (r)),
    rates AS ({rates}),
    own AS (SELECT lang, source, rate, {number("value")} AS b, count(*) AS n FROM rates WHERE NOT base_failed GROUP BY ALL),
    by_lang AS (SELECT lang, rate, b, sum(n) AS n FROM own GROUP BY ALL),
    shares AS (SELECT rate, b, {UNIT} * sum(n) // (SELECT sum(o.n) FROM own o WHERE o.rate = own.rate) AS share FROM own GROUP BY rate, b),
    langs AS (SELECT t.lang, t.rate, s.b, ({UNIT} * coalesce(l.n, 0) + {PRIOR} * s.share) // (t.total + {PRIOR}) AS share FROM (SELECT lang, rate, sum(n) AS total FROM own GROUP BY ALL) t JOIN shares s USING (rate)
      LEFT JOIN by_lang l ON l.lang IS NOT DISTINCT FROM t.lang AND l.rate = t.rate AND l.b = s.b),
    joint AS (SELECT g.lang, g.source, g.rate, l.b, {UNIT} * coalesce(o.n, 0) + {PRIOR} * l.share AS weight FROM (SELECT DISTINCT lang, source, rate FROM own) g JOIN langs l ON l.lang IS NOT DISTINCT FROM g.lang AND l.rate = g.rate
      LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.rate = g.rate AND o.b = l.b),
    q AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, rate ORDER BY b) AS below, sum(weight) OVER (PARTITION BY lang, source, rate) AS total, CASE WHEN b < 64 THEN b ELSE ((b % 32 + 33) << (b // 32 - 1)::INT) - 1 END AS top FROM joint),
    f AS (SELECT lang, source, rate, min(top) FILTER (100 * below >= 50 * total) AS middle, min(top) FILTER (100 * below >= 90 * total) AS high, min(top) FILTER (100 * below >= 98 * total) AS tail FROM q GROUP BY ALL),
    b AS (SELECT lang, source, rate, high + 3 * (high - middle) + (tail - middle) // 4 AS upper FROM f),
    verdict AS (SELECT rates.r, bool_and(coalesce(value <= upper, false)) AS fine FROM rates LEFT JOIN b ON b.lang IS NOT DISTINCT FROM rates.lang AND b.source IS NOT DISTINCT FROM rates.source AND b.rate = rates.rate GROUP BY rates.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM m JOIN verdict USING (r)"""
