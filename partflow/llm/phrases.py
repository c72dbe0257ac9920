"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count phrases and negative border exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.llm.bits import all_set, bit_table, cell_ids
from partflow.llm.common import dropped, mixed, salted_join, stored

SUPPORT, TOP, HOLDING = 10, 2000, 50  # least count, phrases a language, percent of a phrase's places that a longer one may hold
SAMPLE_PARTS, SAMPLE_SUPPORT = 4, 2  # one document in four proposes; a quarter of the support, lowered
PROBES, LOG_BITS = 4, 26  # the filters of admitted words and pairs: 8 MB each, whatever the corpus; a full one admits more, never less
BLOCK, HELD, ROWS = 1 << 20, 4 << 20, 512  # bytes of text counted at a time, bytes that wait for it, rows taken from a batch at a time
TAB = "\t"  # between language and phrase of a key; no phrase holds one

_BREAK = b"."  # every break of the contract becomes this one
_TABLE = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)))


def _segments(texts: list[bytes]) -> Iterator[bytes]:
    """Runs of texts of about a block; a longer run is cut at breaks, which no phrase crosses."""
    held, size = [], 0
    for text in texts:
        held.append(text.translate(_TABLE))
        size += len(text)
        if size >= BLOCK:
            yield from _cut(b".".join(held))
            held, size = [], 0
    if held:
        yield from _cut(b".".join(held))


def _cut(run: bytes) -> Iterator[bytes]:
    at = 0
    while len(run) - at > 2 * BLOCK:
        to = run.find(_BREAK, at + BLOCK)
        if to < 0:
            break
        yield run[at:to]
        at = to + 1
    yield run[at:]


class Block:
    """The words of a run of texts of one language as numbers, with a hash each, and which neighbours make a phrase."""

    def __init__(self, run: bytes, lang: str):
        words = pc.split_pattern(pa.array([run.replace(_BREAK, b" . ").strip() or _BREAK], pa.binary()), b" ").flatten()
        words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary
        self.lang = lang.encode()
        self.first = pc.binary_join_element_wise(self.lang + b"\t", self.words, b"")  # how the words begin a key
        stop = self.words.index(_BREAK).as_py()
        self.word = self.ids != stop
        self.pair = self.word[:-1] & self.word[1:]
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(self.lang + b"\t" + w) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def counted(self, valid: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """Keys and counts of the valid phrases of k words, by the place of their first word."""
        places, size = np.flatnonzero(valid), len(self.words)
        codes, parts = self.ids[places], []
        if size**k < 1 << 63:
            for j in range(1, k):
                codes = codes * size + self.ids[places + j]
            codes, counts = np.unique(codes, return_counts=True)
            for at in reversed(range(k)):
                codes, last = np.divmod(codes, size)
                parts.append((self.words if at else self.first).take(pa.array(last)))
        else:  # so many words that a code of k does not fit: number the shorter phrases first
            for j in range(1, k):
                codes = np.unique(codes, return_inverse=True)[1] * size + self.ids[places + j]
            _, first, counts = np.unique(codes, return_index=True, return_counts=True)
            parts = [(self.words if j else self.first).take(pa.array(self.ids[places[first] + j])) for j in reversed(range(k))]
        return pc.binary_join_element_wise(*reversed(parts), b" ") if k > 1 else parts[0], counts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Runs of about a block with their language, over all batches: a word or phrase is counted once in each. The texts that
    wait for more of their language have HELD bytes at most, whatever the number of languages."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    held = 0
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            held += len(text) + 1
            for full in [lang] if sizes[lang] >= BLOCK else list(sizes) if held >= HELD else []:
                held -= sizes.pop(full)
                yield from ((full, run) for run in _segments(waiting.pop(full)))
    for lang, texts in waiting.items():
        yield from ((lang, run) for run in _segments(texts))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a pair, from those of its words."""
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _cells(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    return cell_ids(hashes, mixed(hashes ^ np.uint64(0xC6A4A7935BD1E995)), PROBES, log_bits)


class Filters:
    """Bloom filters of the words and pairs that longer phrases may be made of."""

    def __init__(self, log_bits: int):
        self.log_bits = log_bits
        self.tables = {k: np.zeros(1 << (log_bits - 3), np.uint8) for k in (1, 2)}

    def grown(self, frequent: DataFrame) -> Filters:
        """With the words and pairs of `frequent` (key) added."""
        out, log_bits = Filters(self.log_bits), self.log_bits
        for k in (1, 2):
            cells = of_words(frequent, k).select("key").mapInArrow(lambda batches: _key_cells(batches, log_bits), "cell long")
            out.tables[k] = self.tables[k] | bit_table(cells, log_bits)
        return out

    def hold(self, k: int, hashes: np.ndarray) -> np.ndarray:
        return all_set(self.tables[k], _cells(hashes, self.log_bits))

    def admitted(self, block: Block, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """By first word: the pairs of two held words, and the triples of two held pairs (of those `among`, if given). A pair
        that is held has held words, so only admitted pairs are looked up."""
        word = self.hold(1, block.hashes)[block.ids]
        pairs = block.pair & word[:-1] & word[1:]
        asked = pairs
        if among is not None:
            asked = np.zeros_like(pairs)
            asked[:-1] |= among
            asked[1:] |= among
            asked &= pairs
        held = np.zeros_like(pairs)
        at = np.flatnonzero(asked)
        hashes = block.hashes[block.ids]
        held[at] = self.hold(2, joined(hashes[at], hashes[at + 1]))
        return pairs, held[:-1] & held[1:]


def _key_hashes(keys: pa.Array) -> np.ndarray:
    """The hashes of words and pairs by their keys; `Block` has the same ones."""
    digest = xxhash.xxh3_64_intdigest
    first, second = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    pairs = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.cast(pa.binary()).to_pylist()):
        lang, _, phrase = key.rpartition(b"\t")
        one, two, rest = phrase.partition(b" ")
        first[i] = digest(lang + b"\t" + one)
        if two:
            pairs[i], second[i] = True, digest(lang + b"\t" + rest)
    return np.where(pairs, joined(first, second), first)


def _key_cells(batches: Iterator[pa.RecordBatch], log_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(_cells(_key_hashes(batch.column("key")), log_bits).ravel())], names=["cell"])


def phrase_of() -> Column:
    return F.substring_index("key", TAB, -1)


def language_of() -> Column:
    return F.expr(f"left(key, length(key) - length(substring_index(key, '{TAB}', -1)) - 1)")


def of_words(counts: DataFrame, k: int) -> DataFrame:
    """The rows of phrases of k words."""
    return counts.filter(F.size(F.split(phrase_of(), " ")) == k)


def _counter(old: Broadcast | None, new: Broadcast | None):
    """Counts of a pass. Without filters: words and pairs (the sample). With new ones alone: words, and what they admit. With
    both: what the new ones admit and the old ones did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _runs(batches):
            block = Block(text, lang)
            if new is None:
                parts = [(block.word, 1), (block.pair, 2)]
            else:
                pairs, triples = new.value.admitted(block)
                parts = [(block.word, 1)] if old is None else []
                if old is not None:
                    old_pairs, old_triples = old.value.admitted(block, triples)
                    pairs, triples = pairs & ~old_pairs, triples & ~old_triples
                parts += [(pairs, 2), (triples, 3)]
            if old is None and new is not None:  # all words of the language, under a key without a phrase
                yield pa.record_batch([pa.array([f"{lang}{TAB}"]), pa.array([int(block.word.sum())], pa.int64())], names=["key", "f"])
            for valid, k in parts:
                keys, counts = block.counted(valid, k)
                yield pa.record_batch([keys.cast(pa.string()), pa.array(counts)], names=["key", "f"])

    return run


def _pass(docs: DataFrame, old: Broadcast | None, new: Broadcast | None) -> DataFrame:
    return docs.select("lang", "text").mapInArrow(_counter(old, new), "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _missed(frequent: DataFrame, filters: Broadcast) -> DataFrame:
    """Frequent words and pairs that the filters do not hold: the border failed there."""

    def run(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~filters.value.hold(k, _key_hashes(batch.column("key")))))

    words, pairs = (of_words(frequent, k).select("key").mapInArrow(lambda batches, k=k: run(batches, k), "key string") for k in (1, 2))
    return words.unionByName(pairs)


def mined_counts(docs: DataFrame, support: int = SUPPORT, sample_parts: int = SAMPLE_PARTS, sample_support: int = SAMPLE_SUPPORT, log_bits: int = LOG_BITS) -> tuple[DataFrame, DataFrame, int]:
    """Counts (key, f) of every phrase of 1 to 3 words with at least `support` occurrences in its language, each exact; words
    a language (lang, n); and the number of full passes.

    docs: lang and text. One document in `sample_parts`, by the hash of its text, proposes the words and pairs seen there at
    least `sample_support` times. The first full pass counts all words and every phrase whose shorter parts are proposed:
    the proposals and their negative border. A border phrase that turns out frequent is added to the proposals and a
    further pass counts what that admits, until nothing is added; no phrase is longer than three words, so this ends.
    """
    context = docs.sparkSession.sparkContext
    said = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sample = said.filter(F.pmod(F.xxhash64("text"), F.lit(sample_parts)) == 0)
    proposed = stored(_pass(sample, None, None).filter(F.col("f") >= sample_support), "proposed")
    filters = context.broadcast(Filters(log_bits).grown(proposed))
    dropped(proposed)
    total = F.endswith("key", F.lit(TAB))
    # phrases below the support are counted and let go: only what is frequent, and a total a language, is written
    counted = stored(_pass(said, None, filters).filter((F.col("f") >= support) | total), "phrases")
    by_lang = counted.filter(total & (F.col("f") > 0)).select(language_of().alias("lang"), F.col("f").alias("n"))
    frequent, passes = counted.filter(~total), 1
    fresh = frequent
    while True:
        missed = stored(_missed(fresh, filters), "missed")
        if missed.isEmpty():
            dropped(missed)
            return frequent, by_lang, passes
        old, filters = filters, context.broadcast(filters.value.grown(missed))
        dropped(missed)
        fresh = stored(_pass(said, old, filters).filter(F.col("f") >= support), "frequent")
        frequent, passes = frequent.unionByName(fresh), passes + 1


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, holding: int = HOLDING, **mining: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of each language.

    Everything is per language (null: und); a null text is empty; repeated rows count each time; columns other than lang and
    text are not read; an empty table gives no rows. a, l and r are the counts of the phrase and of the two parts of its
    worst cut, n all words of the language. The score is exact for counts below 10**16, being decimal arithmetic of 38
    digits. A pair goes when a frequent triple that holds it has `holding` percent of its count.
    """
    frequent, by_lang, _ = mined_counts(docs, support, **mining)
    rows = frequent.select(language_of().alias("lang"), phrase_of().alias("phrase"), "f")
    rows = stored(rows.withColumn("w", F.split("phrase", " ")), "counts")
    counts = rows.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    wide = rows.filter(F.size("w") > 1).select("lang", "phrase", "w", F.col("f").alias("a"))
    cuts = wide.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = salted_join(cuts, counts.withColumnRenamed("count", "l"), ["lang", "part"]).drop("part").withColumnRenamed("rest", "part")
    cuts = salted_join(cuts, counts.withColumnRenamed("count", "r"), ["lang", "part"])
    exact = [F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")]
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *[e.alias(f"{c}x") for e, c in zip(exact, "alr", strict=True)])
    cuts = cuts.withColumn("score", F.expr("CAST(ax * ax * CAST(1000000 AS DECIMAL(7,0)) DIV (lx * rx) AS BIGINT)"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    triples = wide.filter(F.size("w") == 3)
    held = triples.select("lang", F.col("a").alias("longer"), F.explode(F.array(*[F.array_join(F.slice("w", i, 2), " ") for i in (1, 2)])).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = worst.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < holding * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # row_number below a limit: each task keeps that many a language before the shuffle
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(by_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
