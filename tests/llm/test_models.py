"""Encoding, packing, language, quality, chat and the pipeline: round trips, libraries, SQL and held-out accuracy."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from partflow.llm import bpe, chat, language, packing, quality, queries
from partflow.llm.common import stored

SMALL = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_library(name):
    ranks = bpe.parse_ranks(open(public_tokenizers.path(name), "rb").read())
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(items):
    return sorted(items, key=repr)


def test_bpe_matches_the_library_and_decodes(odd, odd_rows, none):
    rows = bpe.decode_bpe(bpe.encode_bpe(odd, MULTI, public_tokenizers.PATTERN).withColumn("packed", F.col("ids")), MULTI).collect()
    library = by_library("byte_bpe_multi_50k.tiktoken")
    want = [(d, np.asarray(library.encode_ordinary(t or ""), "<u4").tobytes(), t or "") for d, t, *_ in odd_rows]
    assert counted((r.doc_id, bytes(r.packed), r.text) for r in rows) == counted(want)
    both = bpe.transcode_bpe(odd, MULTI, public_tokenizers.PATTERN).collect()
    assert counted((r.doc_id, bytes(r.ids), r.text) for r in both) == counted(want) and all(4 * r.n_tokens == len(r.ids) for r in both)
    for empty in (bpe.encode_bpe(none, MULTI, public_tokenizers.PATTERN), bpe.transcode_bpe(none, MULTI, public_tokenizers.PATTERN)):
        assert empty.collect() == [] and bpe.decode_bpe(empty, MULTI).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_transducer_on_random_bytes(name):
    library = by_library(name)
    ours = bpe.PieceEncoder(bpe.parse_ranks(open(public_tokenizers.path(name), "rb").read()), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for i in range(600):
        if i % 3 == 0:
            text = "".join(rng.choice("aabbcdeé ntionßth") for _ in range(60))
        elif i % 3 == 1:
            text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x4E00, 0x4F00), 0x1F600, 10, 0x3000])) for _ in range(40))
        else:
            text = rng.choice("ab=-* x1") * rng.randint(1, 900)
        assert ours.encoded(text) == np.asarray(library.encode_ordinary(text), "<u4").tobytes()


def test_utf8_stream_on_any_cut():
    data = "aé中😀z".encode()
    for cut in range(len(data) + 1):
        stream = bpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode()


def packed_right(rows, wanted, length=1024):
    """Checks pieces against {doc_id: list of ids of its rows} and returns the number of sequences."""
    place, docs = {}, {}
    for r in rows:
        assert 0 < r.length <= length
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for held in place.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= length
    for d, lists in wanted.items():
        want = sorted((p, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes())) for ids in lists for p, s, n in pieces(len(ids), length))
        assert sorted(docs[d]) == want
    return len(place)


def pieces(n, length):
    first = n if n <= length else n % length or length
    cuts = [0, *range(first, n + 1, length)]
    return [(i, a, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_packing(odd, odd_rows, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {}
    for d, t, *_ in odd_rows:
        wanted.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert any(50256 in ids for x in wanted.values() for ids in x)  # the added token stands in a text
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    n = packed_right(packing.pack(odd.coalesce(1), ranks, public_tokenizers.PATTERN, added=added).collect(), wanted)
    assert n <= sum(len(i) for x in wanted.values() for i in x) / 1024 * 1.1 + 1
    packed_right(packing.pack(odd, ranks, public_tokenizers.PATTERN, open_bins=2, added=added).collect(), wanted)
    assert packing.pack(none, ranks, public_tokenizers.PATTERN, added=added).collect() == []


def test_packing_hardly_depends_on_the_cut_of_the_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    ranks, counts = public_tokenizers.path("byte_bpe_50k.tiktoken"), []
    for partitions in (1, 8, 400):
        rows = packing.pack(docs.repartition(partitions), ranks, public_tokenizers.PATTERN).select("sequence_id", "length").collect()
        counts.append(len({r.sequence_id for r in rows}))
    least = -(-sum(r.length for r in rows) // 1024)
    assert max(counts) <= 1.01 * min(counts) and min(counts) <= 1.02 * least
    monkeypatch.setattr(packing, "SECOND_TASK_TOKENS", 100_000)  # several tasks in the second pass
    rows = packing.pack(docs.repartition(64), ranks, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in rows) > 900_000 and len({r.sequence_id >> 36 for r in rows if r.sequence_id >> 62}) > 3


def test_open_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2, 0)
    assert bins.add(6, ("a",)) == [] and bins.add(7, ("b",)) == []
    assert bins.add(8, ("c",)) == [[(8, ("c",))]]
    assert bins.add(3, ("d",)) == [[(7, ("b",)), (3, ("d",))]] and bins.bits == 1 << 4


def test_language_on_held_out_documents(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn_languages(docs)
    truth = {r.doc_id: r.lang for r in docs.filter(language.held_out(F.col("doc_id"))).collect()}
    found = {r.doc_id: r for r in language.identify_languages(docs, model).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found.values())
    assert sum(found[d].lang_pred == x for d, x in truth.items()) >= 0.97 * len(truth)
    rows = language.identify_languages(odd, model, keep=("doc_id", "text")).collect()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {6, 7, 8, 44} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in language.identify_languages(odd, language.learn_languages(none)).collect()} == {"und"}
    assert language.identify_languages(none, model).collect() == []


def test_only_letters_are_letters(spark):
    model = language.fit(["the one and the other", "der eine und der andere"], ["en", "de"])
    texts = ["½ ²", "① ②", "Ⅷ", "١٢", "_", "½ a", "ª", "ー", "中"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify_languages(docs, model).orderBy("doc_id").collect()] == [True] * 5 + [False] * 4


def test_landmarks_of_all_texts_give_exact_kernel_ridge_regression(odd_rows):
    texts = [t[:300] for _, t, *_ in odd_rows if t and len(t) > 100][:12]
    names = ["en" if i % 3 else "de" for i in range(len(texts))]
    model = language.fit(texts, names, landmarks=len(texts), ridge=0.01)
    x = language.presence(texts).astype(float)
    weight = np.diag([len(texts) / (2 * names.count(n)) for n in names])
    wanted = np.asarray([[1.0 if n == g else -1.0 for g in ("de", "en")] for n in names])
    dual = np.linalg.solve(weight @ x @ x.T + 0.01 * len(texts) * np.eye(len(texts)), weight @ wanted)
    other = language.presence(["something else altogether", "und noch etwas"])
    assert np.allclose((other @ model.landmarks.T) @ model.weights, (other @ x.T) @ dual, atol=1e-3)


def test_kernel_counts_shared_grams():
    a, b = language.presence(["abcab", "abd"])
    assert np.isclose(a @ a, 1) and np.isclose(a @ b, 3 / np.sqrt(9 * 6))  # a, b, ab are shared; of 3 + 3 + 3 and 3 + 2 + 1 grams


def against_sql(spark, tmp_path, frame, table, sql, result):
    path = str(tmp_path / f"{table}.parquet")
    frame.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert counted(tuple(r[c] for c in names) for r in result.collect()) == counted(cursor.fetchall())


def test_quality(spark, odd, none, tmp_path):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = quality.judge(stored(quality.measured(odd), "quality")).select(*columns)
    against_sql(spark, tmp_path, odd.select("doc_id", "text", "lang", "source"), "documents", quality.quality_sql(), judged)
    assert quality.judge(quality.measured(none)).collect() == []


def test_bounds_move_smoothly_with_the_size_of_a_group(spark):
    """A group of 1, 199 or 200 documents like those of its language has its language's bound; one that differs gets its own step by step."""
    usual = [("en", "big", 5000, 1000, 0, 10, 0, i % 40) for i in range(2000)]
    columns = "lang string, source string, word_chars long, n_words long, n_repeat_words long, n_lines long, n_dup_lines long, n_symbols long"

    def bound(n, symbols):
        rows = usual + [("en", "own", 5000, 1000, 0, 10, 0, symbols(i)) for i in range(n)]
        frame = spark.createDataFrame(rows, columns).withColumn("base_failed", F.lit(False))
        return quality.thresholds(frame).filter("source_key = '=own' AND rate = 'n_symbols'").first().upper

    assert len({bound(n, lambda i: i % 40) for n in (1, 199, 200)}) == 1
    own = [bound(n, lambda i: 300) for n in (1, 10, 40, 199, 200, 1500)]
    assert own[0] < 200 < min(own[1:]) and own[3] == own[4] == own[5]


def test_sketch_buckets_bound_their_numbers(spark):
    rows = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("bucket")).withColumn("top", quality.upper_end(F.col("bucket"))).collect()
    assert all(r.id <= r.top <= r.id * 33 / 32 + 1 for r in rows)
    assert all(a.bucket <= b.bucket for a, b in zip(rows, rows[1:], strict=False))


def test_chat_branches_and_round_trip(spark):
    said = {1: (None, "system", "<|im_end|>&lt;["), 2: (1, "user", "hi\n<b>"), 3: (2, "assistant", "one &amp; two"), 4: (2, "assistant", ""), 5: (4, "user", None), 6: (5, None, "x"), 7: (99, "us\ner", "lost parent"), 8: (9, "user", "cycle"), 9: (8, "user", "cycle")}
    rows = [("t", n, p, r, t, float(n)) for n, (p, r, t) in said.items()]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(nodes, top=None).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans")))
    got = {r.leaf: ([(t.role, t.text) for t in r.turns], r.loss) for r in out.collect()}
    turn = lambda n: (said[n][1] or "", said[n][2] or "")
    assert got == {3: ([turn(1), turn(2), turn(3)], "one &amp; two"), 6: ([turn(n) for n in (1, 2, 4, 5, 6)], ""), 7: ([turn(7)], "")}
    assert [r.leaf for r in chat.format_trees(nodes, top=1).collect()] == [6]
    assert chat.format_trees(nodes.limit(0)).collect() == []


def test_long_chain(spark):
    nodes = spark.range(1, 301).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    found = chat.paths(nodes).collect()
    assert sorted((r.node, r.back) for r in found) == [(n, 300 - n) for n in range(1, 301)] and {r.path_score for r in found} == {300.0}


def test_chat_query_matches_sql(spark, tmp_path):
    odd = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (2, 5, "assistant", "</s>[INST] <|im_end|>"), (2, 5, None, "&"), (None, 1, "assistant", "z\n"), (None, 0, "assistant", "")]
    frame = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "in/conversations.parquet"))
    against_sql(spark, tmp_path, frame, "conversations", queries.chat_sql(), queries.op10(spark, str(tmp_path / "in")))


def test_language_stage_rejects_noise_only_where_languages_were_learned(spark):
    docs = spark.read.parquet(f"{SMALL.replace("0.001", "0.01")}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rng = random.Random(8)
    noise = [(-1 - i, "".join(chr(rng.choice([rng.randint(0x4E00, 0x9FFF), rng.randint(0x0400, 0x04FF), 32])) for _ in range(300)), None, "s", 300) for i in range(20)]
    noise += [(-30, None, "en", "s", None), (-31, "12 34", "en", "s", 5)]
    mixed = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = {r.doc_id for r in stage(spark, mixed, SMALL).collect()}
    lettered = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len(lettered - kept) <= 0.01 * len(lettered) and sum(d < 0 for d in kept) <= 2
    bare = mixed.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, bare, SMALL).count() == mixed.count()


def test_pipeline_stages(spark, odd, none):
    docs = odd.select(*corpus_pipeline.COLUMNS).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "jaccard_join", "substring_dedup", "packing"]
    for frame in (docs, none):
        for name in list(steps)[:-1]:
            before = {r.doc_id for r in frame.collect()}
            frame = stored(steps[name](spark, frame, SMALL), name)
            assert tuple(frame.columns) == corpus_pipeline.COLUMNS and {r.doc_id for r in frame.collect()} <= before
        ids = {r.doc_id for r in frame.collect()}
        assert {r.doc_id for r in steps["packing"](spark, frame, SMALL).collect()} == ids
        if before:
            assert ids >= {5, 9, 40, 42, 50, 90} and not ids & {2, 3, 4, 6, 7, 8, 10, 44}
            texts = {r.doc_id: r for r in frame.collect()}
            assert all(r.n_chars == len(r.text) for r in texts.values())


def test_pipeline_keeps_one_row_of_repeats_and_null_ids(spark, odd, odd_rows):
    steps = dict(corpus_pipeline.STAGES)
    words = [f"w{i}" for i in range(400)]
    near = lambda at, *change: " ".join("other" if i in change else w for i, w in enumerate(words[at : at + 100]))
    more = [(1, near(0)), (1, near(0)), (None, near(100)), (None, near(100)), (None, near(100, 50)), (None, near(0, 50)), (2, near(200)), (2, near(300)), (4, near(300, 50)), (5, ""), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", len(t)) for i, (d, t) in enumerate(more)], odd.select(*corpus_pipeline.COLUMNS).schema).repartition(3)
    frame = stored(steps["jaccard_join"](spark, docs, SMALL), "jaccard_join")
    kept = counted(tuple(r)[:2] for r in frame.collect())
    assert len(kept) == 6 and kept in ([*counted([(1, near(0)), (2, near(200)), (2, near(300)), (5, ""), (6, ""), (None, near(100, *c))])] for c in ((), (50,)))
    assert [r.source for r in frame.filter("doc_id = 1").collect()] == ["s0"]
    frame = stored(steps["substring_dedup"](spark, frame, SMALL), "substring_dedup")
    assert counted(tuple(r)[:2] for r in frame.collect()) == kept  # one copy stays and loses nothing
    frame = odd.select(*corpus_pipeline.COLUMNS)
    for name in list(steps)[:-1]:
        frame = stored(steps[name](spark, frame, SMALL), name)
    rows = frame.collect()
    assert sum(r.doc_id == 9 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == sum(d is None for d, *_ in odd_rows)


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    firsts = {r.component_id for r in queries.op1(spark, SMALL).collect()}
    assert ids <= {r.doc_id for r in docs.collect()} and len(firsts - ids) <= len(firsts) * 0.02


def test_queries_are_named():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
