"""SimHash near duplicates by Golay-code fuzzy hashing: fingerprints meet in the codewords their segments lie near to."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.llm.bits import all_set, bit_table, cell_ids
from partflow.llm.common import dropped, mixed, salted_join, signed, stored
from partflow.llm.graph import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
DENSE = 1024  # fingerprints of one key that are compared with each other; a key with more goes the way of `_midpoints`
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width of each segment of a fingerprint
GENERATOR, CHECK_BITS, CODE_BITS = 0xC75, 11, 23  # the binary Golay code: every 23-bit word lies within 3 bits of one codeword
PROBES = 3

_SPACES = re.compile(rb"[\x20\x09-\x0d]+")
_HASH_BLOCK = 1 << 16  # shingles whose bits are unpacked at a time


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of every 12-bit message, and the error of at most 3 bits that each of the 2,048 syndromes stands for."""
    powers = [1]
    for _ in range(CODE_BITS - 1):
        x = powers[-1] << 1
        powers.append(x ^ GENERATOR if x >> CHECK_BITS else x)
    message = np.arange(1 << (CODE_BITS - CHECK_BITS), dtype=np.int64)
    high = np.zeros_like(message)
    for bit in range(CODE_BITS - CHECK_BITS):
        high ^= np.where(message >> bit & 1, powers[CHECK_BITS + bit], 0)
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(1, 4):
        for bits in itertools.combinations(range(CODE_BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= powers[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return high, errors


_HIGH, _ERRORS = _remainders()


def codeword(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the Golay codeword nearest to each 23-bit word."""
    syndrome = (words & ((1 << CHECK_BITS) - 1)) ^ _HIGH[words >> CHECK_BITS]
    return (words ^ _ERRORS[syndrome]) >> CHECK_BITS


def near_codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of all words within one bit of each, sorted, and which of them count (repeats do not).

    Two words that differ in two bits or fewer have a word between them within one bit of both, so they share an index.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)])
    found = np.sort(codeword(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]  # at most six codewords lie that near
    return np.take_along_axis(found, order, 1), np.take_along_axis(new, order, 1)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of 4 words, repeats included; fewer words are one shingle, none give no hash."""
    norm = _SPACES.sub(b" ", text.lower()).strip(b" ")
    if not norm:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(norm)]]).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(norm)
    if len(starts) < SHINGLE:
        return np.array([digest(norm, SEED)], np.uint64)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, len(starts) - SHINGLE + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASH_BLOCK):
        part = np.ascontiguousarray(hashes[at : at + _HASH_BLOCK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        prints = np.fromiter((simhash(shingle_hashes(t.as_py() or b"")) for t in texts), np.uint64, len(texts))
        yield pa.record_batch([batch.column("doc_id"), signed(prints)], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as the 64 bits of a long) of every whole text; null and wordless texts have fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fingerprint long")


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint in prints), such that fingerprints within four bits share a key.

    Four errors over three segments leave either one segment without error, another of the other two then having two errors
    or fewer: keys of an exact segment and a near codeword of another. Or every segment has an error, and then none has more
    than two: keys of a near codeword of all three.
    """
    words = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [near_codewords(w, width) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    (a, am), (b, bm), (c, cm) = near
    keys = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    counts = am[:, :, None, None] & bm[:, None, :, None] & cm[:, None, None, :]
    place = np.broadcast_to(np.arange(len(prints))[:, None, None, None], keys.shape)
    out_keys, out_places = [keys[counts]], [place[counts]]
    for kind, (exact, other) in enumerate(itertools.permutations(range(3), 2), 1):
        code, mask = near[other]
        keys = kind << 36 | words[exact][:, None] << 12 | code
        out_keys.append(keys[mask])
        out_places.append(np.broadcast_to(np.arange(len(prints))[:, None], keys.shape)[mask])
    return np.concatenate(out_keys), np.concatenate(out_places)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_prints), 1024):
            yield pa.record_batch([pa.array(fuzzy_keys(all_prints[at : at + 1024])[0])], names=["key"])


def _cells(keys: np.ndarray, log_bits: int) -> np.ndarray:
    one = mixed(keys.astype(np.uint64))
    return cell_ids(one, mixed(one ^ np.uint64(GENERATOR)), PROBES, log_bits)


def _marked(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the keys and the logarithm of its bits: 16 a key, but never more than 2**28, which are 32 MB."""
    log_bits = min(28, max(20, (16 * keys.count()).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _cells(batch.column("key").to_numpy(zero_copy_only=False), log_bits)
            yield pa.record_batch([pa.array(found.ravel())], names=["cell"])

    return bit_table(keys.select("key").mapInArrow(cells, "cell long"), log_bits), log_bits


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger, smaller) that connect what links of at most four bits connect, one fewer than a component's members."""
    prints = np.sort(prints.view(np.int64)).view(np.uint64)
    n = len(prints)
    near = np.empty((n, n), bool)
    for at in range(0, n, 128):
        near[at : at + 128] = np.bitwise_count(prints[at : at + 128, None] ^ prints[None, :]) <= MAX_BITS
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = np.flatnonzero(label != np.arange(n))
    return prints[rest], prints[label[rest]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = batch.column("prints")
        flat = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = groups.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes == 2]
        left, right = flat[first], flat[first + 1]
        close = np.bitwise_count(left ^ right) <= MAX_BITS
        left, right = (f(left.view(np.int64), right.view(np.int64)).view(np.uint64) for f in (np.maximum, np.minimum))
        pairs = [(left[close], right[close])]
        pairs += [forest(flat[to - n : to]) for n, to in zip(sizes.tolist(), ends.tolist()) if n > 2]
        yield pa.record_batch([signed(np.concatenate([p[i] for p in pairs])) for i in (0, 1)], names=["a", "b"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every point within two bits of each fingerprint. All fingerprints at one point lie within four bits of each other, and
    any two within four bits have a point in common; a point has at most 2,081 of them."""
    one = [np.uint64(1) << np.uint64(b) for b in range(64)]
    flips = np.array([np.uint64(0), *one, *(a | b for a, b in itertools.combinations(one, 2))], np.uint64)
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 32):
            part = prints[at : at + 32]
            yield pa.record_batch([signed((part[:, None] ^ flips[None, :]).ravel()), signed(np.repeat(part, len(flips)))], names=["point", "fingerprint"])


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect exactly what links of at most four differing bits connect.

    prints: distinct fingerprints. Keys are counted first. Those with company, and those with more than `dense` fingerprints,
    are marked in Bloom filters of bounded size, so that lonely keys are not dealt again. Up to `dense` fingerprints of a key
    are compared in one task; a key that may have more sends its fingerprints to midpoints instead, in groups of bounded
    size. A filter's false hits cost work and change nothing.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("fingerprint").repartition(tasks, "fingerprint")
    company = stored(dealt.mapInArrow(_keyed, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    filters = prints.sparkSession.sparkContext.broadcast([_marked(company), _marked(company.filter(F.col("n") > dense))])

    def accompanied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys with company; of a crowded one no more than that it is."""
        for batch in batches:
            all_prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_prints), 1024):
                part = all_prints[at : at + 1024]
                keys, places = fuzzy_keys(part)
                met, crowded = (all_set(table, _cells(keys, log_bits)) for table, log_bits in filters.value)
                full = np.unique(places[met & crowded])
                met &= ~crowded
                yield pa.record_batch([pa.array(np.concatenate([keys[met], np.full(len(full), -1)])), signed(np.concatenate([part[places[met]], part[full]]))], names=["key", "fingerprint"])

    keyed = dealt.mapInArrow(accompanied, "key long, fingerprint long")
    cold = keyed.filter("key >= 0").groupBy("key").agg(F.collect_list("fingerprint").alias("prints")).filter(F.size("prints") > 1)  # at most `dense`
    pairs = cold.select("prints").mapInArrow(_verified, "a long, b long")
    at_points = keyed.filter("key < 0").select("fingerprint").repartition(tasks, "fingerprint").mapInArrow(_midpoints, "point long, fingerprint long")
    met = at_points.groupBy("point").agg(F.min("fingerprint").alias("b"), F.collect_list("fingerprint").alias("prints")).filter(F.size("prints") > 1)
    stars = met.select(F.explode("prints").alias("a"), "b").filter("a <> b")
    return _small_stars(_small_stars(pairs.unionByName(stars).distinct()))


def _small_stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), b the smaller, with each a's other partners hung on its smallest: as connected, but a crowd that met at
    many keys keeps about one pair a member. A fingerprint has few keys and points, so its partners are few."""
    held = pairs.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("others"))
    hung = held.select(F.explode(F.concat(F.array("a"), F.array_remove("others", F.col("least")))).alias("a"), F.col("least").alias("b"))
    return hung.distinct()


def simhash_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id) of every row of docs.

    component_id is the smallest doc_id that links of four or fewer differing bits reach, the row itself included. Null and
    wordless texts have fingerprint zero and link like any other. Rows that repeat a doc_id or a text are rows of their own.
    A row without doc_id takes part in links; its component_id is null if all it reaches lack an id. An empty table gives no
    rows. Other columns of docs are not read.
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    label = components(links(distinct, dense))
    labelled = distinct.join(label, distinct.fingerprint == label.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    labelled = stored(labelled, "simhash-labels")
    first = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(salted_join(labelled, first, ["component"]).select("fingerprint", "component_id"), "simhash-components")
    dropped(distinct), dropped(labelled)
    found = salted_join(prints, named, ["fingerprint"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
