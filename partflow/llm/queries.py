"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.llm.chat import ESCAPES, OPEN, CLOSE, format_trees, linear_nodes, masked, read_back
from partflow.llm.bpe import transcode_bpe
from partflow.llm.common import read, stored
from partflow.llm.fingerprints import fingerprint_chain
from partflow.llm.jaccard import near_duplicates
from partflow.llm.language import held_out, identify_languages, learn_languages
from partflow.llm.licenses import notices, scan_licenses, scan_sql
from partflow.llm.lines import dedup_lines
from partflow.llm.packing import added_tokens, pack
from partflow.llm.phrases import collocations
from partflow.llm.quality import judge, measured, quality_sql
from partflow.llm.simhash import simhash_duplicates
from partflow.llm.substrings import dedup_substrings
from partflow.llm.trie import prefix_trie


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").withColumn("notices", F.array_join(notices(spark, F.col("text")), ","))
    return scan_licenses(docs, keep=("doc_id", "notices"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_chain(read(spark, folder, "documents"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = transcode_bpe(read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    base = stored(measured(read(spark, folder, "documents")), "quality")
    return judge(base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_substrings(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = identify_languages(docs, learn_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


CONTROL = "</s>[INST] ok [/INST]"  # what conversation -7 says


def op10(spark: SparkSession, folder: str) -> DataFrame:
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    nodes = stored(linear_nodes(read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)), "messages")
    out = format_trees(nodes).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    named = F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id")
    return out.select(named, F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_sql() -> str:
    body, name = "text", "role"
    for plain, safe in ESCAPES[:-1]:
        body, name = f"replace({body}, '{plain}', '{safe}')", f"replace({name}, '{plain}', '{safe}')"
    name = f"replace({name}, chr(10), '{ESCAPES[-1][1]}')"
    order = "ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST"
    return f"""WITH c AS (SELECT conv_id, turn, role AS role0, text AS text0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
      (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length({name}) + length({body}) + {len(OPEN) + 1 + len(CLOSE)})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_duplicates(read(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(read(spark, folder, "conversations")).drop("n_ends")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents"))


# CRC-32 of the decimal digits of conv_id, bit by bit: 3988292384 is the fixed reflected polynomial, 4294967295 start and final mask
CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"""

TRIE_SQL = f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
    stems AS (SELECT c.conv_id, c.h, least(c.h, count(b.pos))::BIGINT AS stem FROM convs c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100 GROUP BY c.conv_id, c.h),
    turns AS (SELECT s.conv_id, b.pos AS depth, b.role, b.text FROM stems s JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100 AND b.pos <= s.stem
      UNION ALL SELECT o.conv_id, o.pos - s.h + s.stem, o.role, o.text FROM own o JOIN stems s USING (conv_id) WHERE o.pos > s.h),
    prefixes AS (SELECT conv_id, depth, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') OVER (PARTITION BY conv_id ORDER BY depth)) AS p, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS turns FROM turns
      UNION ALL SELECT s.conv_id, 0, '', 0, (SELECT count(*) FROM turns t WHERE t.conv_id = s.conv_id) FROM stems s),
    nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (depth = turns) AS n_ends, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '') AS ends FROM prefixes GROUP BY p, depth),
    ups AS (SELECT n.p, n.depth, u.p AS up, u.depth AS up_depth, u.conv_id AS up_conv FROM nodes n JOIN prefixes x ON x.p = n.p AND x.depth = n.depth AND x.conv_id = n.conv_id JOIN prefixes y ON y.conv_id = x.conv_id AND y.depth <= x.depth JOIN nodes u ON u.p = y.p AND u.depth = y.depth),
    below AS (SELECT a.up AS p, a.up_depth AS depth, count(*) FILTER (a.depth = a.up_depth + 1) AS n_children, count(*) FILTER (n.n_ends = n.n_convs) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens FROM ups a JOIN nodes n ON n.p = a.p AND n.depth = a.depth GROUP BY ALL)
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.up_conv AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN below b ON b.p = n.p AND b.depth = n.depth LEFT JOIN ups u ON u.p = n.p AND u.depth = n.depth AND u.up_depth = n.depth - 1"""

PHRASE_SQL = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    counts AS (SELECT lang, k, p, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p FROM words, (VALUES (1), (2), (3)) ks(k)) GROUP BY lang, k, p),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
    wide AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
    cuts AS (SELECT c.lang, c.p, c.a, c.j, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM wide) c JOIN counts l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.j], ' ') JOIN counts r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.j + 1:], ' ')),
    worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
    held AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a FROM wide WHERE k = 3) GROUP BY lang, p),
    rest AS (SELECT x.* FROM worst x LEFT JOIN held h ON h.lang = x.lang AND h.p = x.p WHERE h.longer IS NULL OR 100 * h.longer < 50 * x.a)
    SELECT lang, rank, p AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM rest) JOIN totals USING (lang) WHERE rank <= 2000"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1,
    "op2_license_scan": op2,
    "op3_lz_fingerprints": op3,
    "op4_line_dedup": op4,
    "op5_byte_bpe": op5,
    "op6_quality_rules": op6,
    "op7_substring_dedup": op7,
    "op8_language_id": op8,
    "op9_best_fit_packing": op9,
    "op10_chat_trees": op10,
    "op11_simhash_dedup": op11,
    "op12_prefix_trie": op12,
    "op13_phrase_mining": op13,
}
SQL: dict[str, str] = {"op2_license_scan": scan_sql(), "op6_quality_rules": quality_sql(), "op10_chat_trees": chat_sql(), "op12_prefix_trie": TRIE_SQL, "op13_phrase_mining": PHRASE_SQL}
